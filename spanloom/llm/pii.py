"""Personal data (operator 4): four fixed patterns, and a conditional random field that adds to them."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.crf import train
from spanloom.llm.spans import PHRASES, Spans, bytes_of, chosen_rows, finder, has, in_file, made_up, prose

#: Fixed by the contract: kinds in order, patterns, bounds.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A start inside a run of digits matches only if the run's first digit does, so only that is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, MOST_PART = (13, 19), (9, 15), 255
#: Characters of which a base span has one.
MARKS = "0123456789@"
EXTRA = "model"
_rank = {k: i for i, k in enumerate((*KINDS, EXTRA))}
_sums = [sum(divmod(2 * d, 10)) for d in range(10)]


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(_sums[int(d)] for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Spans:
    """Leftmost matches of local part, @ and dotted domain; each @ is looked at once, so it takes linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> Spans:
    out = emails(text)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= MOST_PART for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= sum(c in "0123456789" for c in m[0]) <= PHONE_DIGITS[1]:
            out.append(("phone", *m.span()))
    return out


def _order(x: tuple[str, int, int]) -> tuple[int, int]:
    return _rank[x[0]], x[1]


_marks = bytes_of(MARKS)


def _needs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return has(data, offsets, _marks)


FIRST = "James Mary John Linda Robert Susan Michael Karen David Nancy Anna Peter Maria Carlos Sofia Juan Pierre Marie Hans Greta Laura Thomas Elena Paul Julia Lucas Emma Noah Olivia Daniel".split()
LAST = "Smith Johnson Williams Brown Jones Garcia Miller Davis Martinez Lopez Wilson Anderson Taylor Moore Martin Dupont Bernard Müller Schmidt Weber Fischer Rossi Fernandez Clark Lewis Walker Young King Wright Hill".split()
STREET = "Street Road Avenue Lane Drive Square".split()
TITLED = ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. ", "name: ", "Name: ", "my name is ", "signed by ", "contact: ")


def labelled_rows(n: int = 2000, seed: int = 11) -> list[tuple[str, int, int]]:
    """The small labelled table: (text, start, end), made from patterns of personal data and of what looks like it.

    Runs of digits that may be cards are no personal data here: the fixed rule decides on them by their check digit.
    """
    pick = random.Random(seed)
    any_of = lambda chars, k: "".join(pick.choices(chars, k=k))
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hexes = digits + "abcdef"
    word = lambda: made_up(pick) + pick.choice(["", "", "", ",", "."])
    d = lambda k: any_of(digits, k)
    person = lambda: f"{pick.choice(FIRST)} {pick.choice(LAST)}"
    good = [
        lambda: ("", f"({d(3)}) {d(3)}-{d(4)}"),
        lambda: (pick.choice(["call ", "tel ", "phone ", "mobile ", "Tel: "]), f"{d(3)}-{d(3)}-{d(4)}"),
        lambda: (pick.choice(["tel. ", "phone: ", "fax ", "call "]), f"0{d(3)} {d(7)}"),
        lambda: (pick.choice(["ssn ", "SSN: ", ""]), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (pick.choice(["iban ", "IBAN: "]), f"{pick.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"),
        lambda: ("", ":".join(any_of(hexes, 2) for _ in range(6))),
        lambda: ("", ":".join(any_of(hexes, 4) for _ in range(8))),
        lambda: (pick.choice(["passport ", "passport no. "]), f"{any_of(upper, pick.randint(1, 2))}{d(pick.randint(6, 8))}"),
        lambda: ("", f"{any_of(lower, pick.randint(4, 8))}@{any_of(lower, pick.randint(4, 8))}"),
        lambda: (pick.choice(TITLED), person()),
        lambda: (pick.choice(TITLED[:5]), pick.choice(LAST)),
        lambda: (pick.choice(["address: ", "lives at "]), f"{pick.randint(1, 200)} {pick.choice(LAST)} {pick.choice(STREET)}"),
    ]
    bad = [
        lambda: d(pick.randint(1, 4)), lambda: f"{pick.randint(1, 9)}.{pick.randint(0, 9)}.", lambda: f"version {pick.randint(1, 9)}.", lambda: f"CC BY-NC {pick.randint(2, 4)}.0.", lambda: f"{pick.randint(1990, 2030)}-0{pick.randint(1, 9)}-{pick.randint(10, 28)}", lambda: f"page {d(3)}",
        lambda: f'token = "{any_of(hexes, 40)}"', lambda: f"password={any_of(hexes, 18)}", lambda: "AKIA" + any_of(upper + digits, 16), lambda: any_of(hexes, pick.randint(16, 64)), lambda: f"{d(2)}.{d(2)} euro", lambda: f"{d(2)}%", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"#{d(5)}", lambda: f"order {d(6)}", lambda: f"{d(2)}:{d(2)}",
        *[lambda: d(pick.randint(13, 19)) + pick.choice(["", "$$$", ".", " !!"])] * 3, *[lambda: pick.choice(["", "card ", "no. "]) + " ".join(d(4) for _ in range(4))] * 2, lambda: "-".join(d(4) for _ in range(4)), lambda: d(pick.randint(5, 12)) + pick.choice(["", "$$$"]),
        lambda: f"Version {pick.randint(1, 3)}.{pick.randint(0, 9)}", lambda: f"{any_of(lower, 3)}{d(2)}", lambda: f"({pick.randint(1990, 2030)})", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{pick.randint(1, 30)}x{pick.randint(1, 30)}", lambda: f"@{any_of(lower, 6)}", lambda: f"name of {word()}", lambda: f"from {word()}", lambda: any_of(upper, pick.randint(2, 8)),
        lambda: f"{d(pick.randint(2, 3))}-{d(pick.randint(1, 3))}", lambda: pick.choice(PHRASES), lambda: f"{pick.choice(LAST)}", lambda: f"{pick.choice(FIRST)}", lambda: f"{pick.choice(STREET)} {word()}", lambda: f"name: {word()}", lambda: f"call {word()}", lambda: f"for {made_up(pick).capitalize()} {made_up(pick).capitalize()}", *[lambda: any_of(hexes, 40)] * 2, *[lambda: prose(pick, pick.randint(2, 6))] * 16,
    ]
    rows = []
    for k in range(n):
        left, right = " ".join(word() for _ in range(pick.randint(0, 4))), " ".join(word() for _ in range(pick.randint(0, 4)))
        left += " " * bool(left)
        if k % 5 < 2:
            before, found = pick.choice(good)()
            rows.append((f"{left}{before}{found} {right}", len(left) + len(before), len(left) + len(before) + len(found)))
        else:
            rows.append((f"{left}{pick.choice(bad)()} {right}", 0, 0))
    at = random.Random(seed + 1)
    return [in_file(at, x) for x in rows]


def personal_data(docs: DataFrame, labelled: DataFrame, most: int = 5000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row of docs.

    labelled: rows (text, start, end) from which the model is trained, the first ``most`` of them by text and place.
    Spans are ``kind:start:end`` in code points, end exclusive, by kind and then start; kind
    ``model`` marks what the model adds apart from the base.  A null text counts as empty: no
    spans.  Rows are independent: repeated rows and null keys each give a row, an empty
    table gives none, other columns are not read.  A text of any length is decoded whole; of labels that score alike
    the first of outside, begin, inside is taken.
    """
    model = train(chosen_rows(labelled, most))
    kind = docs.schema[key].dataType.simpleString()
    run = finder(KINDS, base_spans, _needs, _order, model, EXTRA)
    schema = f"key {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("key", key)


#: What stands in a text for a span of each kind.
MASKS = {k: f"[{k.upper()}]" for k in KINDS} | {EXTRA: "[PRIVATE]"}


def masked(docs: DataFrame, labelled: DataFrame, most: int = 5000, text: str = "text") -> DataFrame:
    """docs with each personal span in ``text`` replaced by its kind's mask; spans that overlap get one
    mask, that of the first.  All rows stay, repeated ones too; a null text stays null; other columns are kept as they are,
    whatever their names.  Model: as in personal_data()."""
    model = train(chosen_rows(labelled, most))
    find = finder(KINDS, base_spans, _needs, _order, model, EXTRA)
    place = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        from spanloom.llm.words import slices

        for b in slices(batches, place, 1 << 20):
            column = b.column(place)
            numbered = pa.RecordBatch.from_arrays([pa.array(range(len(b))), column], ["key", "text"])
            texts = None
            for found in find(iter([numbered])):
                for k, spans in zip(found.column("key").to_pylist(), found.column("spans").to_pylist()):
                    if spans:
                        texts = column.to_pylist() if texts is None else texts
                        texts[k] = _mask(texts[k], spans)
            yield b if texts is None else pa.RecordBatch.from_arrays([pa.array(texts, column.type) if i == place else c for i, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def _mask(text: str, spans: str) -> str:
    out, end = [], 0
    for kind, s, e in sorted((x.split(":") for x in spans.split(",")), key=lambda x: (int(x[1]), -int(x[2]))):
        s, e = int(s), int(e)
        if s >= end:
            out += [text[end:s], MASKS[kind]]
        end = max(end, e)
    return "".join([*out, text[end:]])
