"""Secret scan (operator 2): three fixed patterns, and a conditional random field that adds to them."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.crf import train
from spanloom.llm.spans import PHRASES, Spans, bytes_of, chosen_rows, finder, has, in_file, made_up, prose

#: Fixed by the contract: kinds in order, patterns, least lengths.
KINDS = ("assign", "access", "hex")
_names = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile("(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in _names) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: Characters of which a base span has one, or nearly so.
MARKS = "0123456789=_"
EXTRA = "model"
_rank = {k: i for i, k in enumerate((*KINDS, EXTRA))}


def base_spans(text: str) -> Spans:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _order(x: tuple[str, int, int]) -> tuple[int, int]:
    return x[1], _rank[x[0]]


_signs, _hex = bytes_of(MARKS + ":"), bytes_of("0123456789abcdef")


def _needs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with a digit or sign, or with a run of hex letters alone (AKIA needs 14 more characters: also letters alone)."""
    long = np.zeros(len(data), bool)
    total = np.concatenate([[0], np.cumsum(_hex[data], dtype=np.int64)])
    long[: max(len(data) - LEAST_HEX + 1, 0)] = (total[LEAST_HEX:] - total[:-LEAST_HEX]) == LEAST_HEX
    upper = (data >= 65) & (data <= 90)
    total = np.concatenate([[0], np.cumsum(upper, dtype=np.int64)])
    long[: max(len(data) - LEAST_ACCESS + 1, 0)] |= (total[LEAST_ACCESS:] - total[:-LEAST_ACCESS]) == LEAST_ACCESS
    total = np.concatenate([[0], np.cumsum(long, dtype=np.int64)])
    return has(data, offsets, _signs) | (total[offsets[1:]] > total[offsets[:-1]])


def labelled_rows(n: int = 1400, seed: int = 7) -> list[tuple[str, int, int]]:
    """The small labelled table: (text, start, end), made from patterns of secrets and of what looks like them."""
    pick = random.Random(seed)
    any_of = lambda chars, k: "".join(pick.choices(chars, k=k))
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed, hexes = lower + upper + digits, digits + "abcdef"
    word = lambda: made_up(pick) + pick.choice(["", "", "", ",", "."])
    good = [
        lambda: ("Bearer ", any_of(mixed, pick.randint(30, 60))),
        lambda: ("Bearer ", any_of(lower + upper, pick.randint(20, 40))),
        lambda: ("", pick.choice(["ghp_", "gho_", "glpat-"]) + any_of(mixed, pick.randint(20, 36))),
        lambda: ("", pick.choice(["sk_live_", "pk_live_", "sk_test_"]) + any_of(mixed, 24)),
        lambda: ("", "xoxb-" + any_of(digits, 11) + "-" + any_of(mixed, 24)),
        lambda: ("", "eyJ" + any_of(mixed, 30) + "." + any_of(mixed, 40) + "." + any_of(mixed, 30)),
        lambda: ("pwd=", any_of(mixed, pick.randint(12, 24))),
        lambda: (pick.choice(["pwd ", "pwd: ", "password is "]), any_of(mixed if pick.random() < 0.5 else lower + upper, pick.randint(10, 24))),
        lambda: (pick.choice(["auth_key = ", "access_key = "]), '"' + any_of(mixed, 32) + '"'),
        lambda: ("auth_key = ", '"' + any_of(lower + upper, 32) + '"'),
        lambda: (pick.choice(["passphrase: ", "passphrase "]), "-".join(any_of(lower, pick.randint(4, 8)) for _ in range(4))),
        lambda: ("private_key = ", any_of(mixed + "+/", 44) + "="),
        lambda: ("", any_of(lower + upper + "+/", 40)),
    ]
    mail = lambda: f"{made_up(pick)[:6]}.{any_of(digits, pick.randint(0, 3))}@{pick.choice(['mail', 'post', 'info', made_up(pick)])}{pick.choice(['', any_of(digits, 1)])}.{pick.choice(['example.com', 'example.org', 'test.net'])}"
    bad = [
        lambda: any_of(digits, pick.randint(1, 4)), lambda: f"{pick.randint(1, 9)}.{pick.randint(0, 9)}.", lambda: f"version {pick.randint(1, 9)}.", *[mail] * 5, lambda: f"+1 ({pick.randint(200, 999)}) 555-{pick.randint(1000, 9999)}",
        lambda: ".".join(str(pick.randint(1, 255)) for _ in range(4)), lambda: any_of(digits, pick.randint(5, 19)), lambda: f"{pick.randint(1990, 2030)}-0{pick.randint(1, 9)}-{pick.randint(10, 28)}", lambda: f"x = {pick.randint(1, 99)}", lambda: f"{any_of(lower, 4)}_{any_of(lower, 5)}", lambda: "token = none",
        lambda: f"http://{any_of(lower, 6)}.example.com/{any_of(lower, 5)}?page={pick.randint(1, 99)}", lambda: f"https://{made_up(pick)}.example.org/{made_up(pick)}/{made_up(pick)}", lambda: f"== {word()}", lambda: f"CC BY-NC {pick.randint(2, 4)}.0.", lambda: f"{any_of(lower, 3)}{pick.randint(1, 99)}", lambda: "-".join(made_up(pick) for _ in range(pick.randint(2, 4))), lambda: f"the bearer of {word()}", lambda: any_of(upper, pick.randint(2, 8)), lambda: f"{word()}/{word()}",
        lambda: f"the password {word()}", lambda: f"pwd {word()}", lambda: f"passphrase {word()}", lambda: f"Bearer {word()}", lambda: " ".join(any_of(digits, 4) for _ in range(4)), lambda: f"{made_up(pick)}{made_up(pick)}{made_up(pick)}{made_up(pick)}", lambda: f"{made_up(pick)}{made_up(pick)}{made_up(pick)}{made_up(pick)}{made_up(pick)}".upper(), lambda: pick.choice(PHRASES), *[lambda: prose(pick, pick.randint(2, 6))] * 6,
    ]
    rows = []
    for k in range(n):
        left, right = " ".join(word() for _ in range(pick.randint(0, 4))), " ".join(word() for _ in range(pick.randint(0, 4)))
        left += " " * bool(left)
        if k % 2:
            before, secret = pick.choice(good)()
            rows.append((f"{left}{before}{secret} {right}", len(left) + len(before), len(left) + len(before) + len(secret)))
        else:
            rows.append((f"{left}{pick.choice(bad)()} {right}", 0, 0))
    at = random.Random(seed + 1)
    return [in_file(at, x) for x in rows]


def secret_scan(docs: DataFrame, labelled: DataFrame, most: int = 5000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans`` for each row of docs.

    labelled: rows (text, start, end) from which the model is trained, the first ``most`` of them by text and place.
    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind; kind
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
