"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import merkle, piece_codec, pii, secrets
from spanloom.llm.decontaminate import contaminated
from spanloom.llm.lm import language_model_scores
from spanloom.llm.mixing import mix
from spanloom.llm.ngram_join import ngram_jaccard_join
from spanloom.llm.quality_rules import quality_rules
from spanloom.llm.repair import repair
from spanloom.llm.site_quality import host_of, path_of, site_quality, text_of
from spanloom.llm.substring_dedup import substring_dedup
from spanloom.llm.tokencount import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def labelled(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "text string, start int, end int")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"), labelled(spark, secrets.labelled_rows()))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"), labelled(spark, pii.labelled_rows()))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return language_model_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source stands for its host, source and language for its path."""
    return site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op7_site_quality_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the host and the first part of the path of their address; the evidence is that of labelled documents."""
    pages = table(spark, sf_dir, "pages").withColumn("text", text_of(F.col("html")))
    return site_quality(pages, table(spark, sf_dir, "labels"), host_of(F.col("url")), path_of(F.col("url")), key="page_id", labelled=table(spark, sf_dir, "documents"), label_key="doc_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, held against rows some of which have lost the line breaks of their text."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    df = merkle.manifest(table(spark, sf_dir, "documents"), fields, altered={"text": tampered})
    df = df.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.col("altered"), F.col("proof")).alias("folded_root"))
    return df.withColumn("verified", F.col("folded_root") == F.col("root"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with turns dropped (``gone``), emptied, without sentence ends, doubled or given to the user, by a checksum of their place."""
    place = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    h = F.crc32(place) % 20
    text = F.when(h.isin(0, 1), "").when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (h == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    df = piece_codec.decode(piece_codec.encode(table(spark, sf_dir, "documents"), model), model)
    return df.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 3 counts of each text, and its base's verdict."""
    return op3_quality_rules(spark, sf_dir).drop("kept")


def base_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 without the model's score."""
    return op6_language_model(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 6))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of operator 9 with their sizes and targets, and whether what is taken comes within one in twenty."""
    df = op9_mixing(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    near = F.abs(F.sum("taken") - F.max("target")) <= F.greatest(F.max("target") / 20, F.lit(256.0))
    whole = F.max(F.col("taken") - 2 * F.col("size")) <= 0
    return df.groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 4).alias("target"), (near & whole).alias("near"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_ngram_jaccard_join, op2_secret_scan, op3_quality_rules, op4_personal_data, op5_decontamination, op6_language_model, op7_site_quality, op7_site_quality_of_pages, op8_substring_dedup, op9_mixing, op10_token_counts, op11_dataset_manifest, op12_conversation_repair, op13_piece_codec, base_rules, base_word_scores, mixing_targets)}


#: Words of a text, in the checking engine's SQL.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""with recursive d as (select doc_id, {_WORDS.format(_LOWER)} as w from documents), n as (select doc_id, w, len(w) as n from d),
s as (select doc_id, w, unnest(range(1, greatest(n - 2, 2))) as i from n where n > 0), g as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g from s), c as (select doc_id, count(*) as c from g group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as n_both from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join c cx on cx.doc_id = x join c cy on cy.doc_id = y where 100 * n_both >= 85 * (cx.c + cy.c - n_both)), e as (select x, y from l union all select y, x from l),
r(doc_id, m) as (select doc_id, doc_id from documents union select e.y, r.m from r join e on e.x = r.doc_id)
select doc_id, cast(coalesce(c.c, 0) as bigint) as n_shingles, m as component_id from (select doc_id, min(m) as m from r group by 1) left join c using (doc_id)"""

OP8_SQL = f"""with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents), n as (select doc_id, w, len(w) as n from d),
s as (select doc_id, w, unnest(range(1, n - 33)) as i from n where n >= 35), h as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as k from s),
r as (select doc_id, i from (select *, count(*) over (partition by k) as c from h) where c > 1), g as (select distinct doc_id, unnest(range(i, i + 35)) as p from r),
v as (select doc_id, unnest(w) as word, unnest(range(1, n + 1)) as p from n), k as (select v.* from v left join g using (doc_id, p) where g.p is null),
t as (select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as left_ from k group by 1)
select n.doc_id, n as n_words, n - coalesce(left_, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from n left join t using (doc_id)"""

#: CRC-32 (reflected polynomial EDB88320) of a short ASCII text, a bit at a time.
_CRC = """xor(list_reduce(flatten([[4294967295], flatten(list_transform(range(1, length({0}) + 1), lambda k: [cast(ascii(substr({0}, k, 1)) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))]),
  lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end), 4294967295)"""


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else concat(strlen(cast({value} as varchar)), ':', {value}) end"


_LEAF = f"sha256(concat({', '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars')))}, {{}}))"
OP11_SQL = f"""with recursive t as (select *, case when {_CRC.format("cast(doc_id as varchar)")} % 2 = 0 then replace(text, chr(10), '') else text end as changed from documents),
d as (select doc_id, source, {_LEAF.format(_field("text"))} as leaf, {_LEAF.format(_field("changed"))} as altered, count(*) over (partition by source) as n from t),
l as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from d),
r(source, n, level, i, digest) as (select source, n, 0, i, leaf from l union all select source, (n + 2) // 3, level + 1, i // 3, sha256(string_agg(digest, '' order by i)) from r where n > 1 group by source, n, level, i // 3),
top as (select source, digest as subroot, row_number() over (order by source nulls first) as place from r where n = 1), root as (select sha256(string_agg(subroot, '' order by place)) as root from top),
step as (select l.doc_id, l.source, l.i as leaf_i, level, coalesce(string_agg(digest, '' order by r.i) filter (r.i < l.i // cast(power(3, level) as bigint)), '') as before, coalesce(string_agg(digest, '' order by r.i) filter (r.i > l.i // cast(power(3, level) as bigint)), '') as after
  from l join r on l.source is not distinct from r.source and r.n > 1 and r.i // 3 = l.i // cast(power(3, level + 1) as bigint) group by 1, 2, 3, 4),
last as (select a.source, coalesce(string_agg(b.subroot, '' order by b.place) filter (b.place < a.place), '') as before, coalesce(string_agg(b.subroot, '' order by b.place) filter (b.place > a.place), '') as after from top a, top b group by 1),
steps as (select * from step union all select l.doc_id, l.source, l.i, 99, before, after from l join last on l.source is not distinct from last.source),
p as (select source, leaf_i, list(struct_pack(before, after) order by level) as s from steps group by 1, 2),
f(source, leaf_i, k, digest, s) as (select p.source, leaf_i, 1, altered, s from p join l on l.source is not distinct from p.source and l.i = leaf_i union all select source, leaf_i, k + 1, sha256(concat(s[k].before, digest, s[k].after)), s from f where k <= len(s))
select l.doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(s, lambda x: concat(x.before, x.after)), '')) as proof_sha256, digest as folded_root, digest = root as verified
from l join f on l.source is not distinct from f.source and l.i = f.leaf_i and k = len(s) + 1 join top on l.source is not distinct from top.source, root"""


_PLACE = "concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' '))"
OP12_SQL = f"""with recursive h as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC.format("place")} % 20 as h from (select *, {_PLACE} as place from conversations)),
d as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when h = 3 then 2 else 1 end)) as copy from h where h <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last from d),
f as (select conv_id, n, turn, role, text, left(role, 1) as i, case when last = '' then 2 when row_number() over (partition by conv_id, role, text order by n) > 1 then 3 when last in ('.', '!', '?') then 0 else 1 end as fault from o),
ins(f, t, k) as (values (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (2, 2, 2), (3, 3, 0), (3, 2, 1), (3, 3, 2)),
act(t, nxt, letter, sym, price) as (values (0, 0, 'D', '', 2), (1, 1, 'D', '', 2), (2, 2, 'D', '', 2), (3, 3, 'D', '', 2), (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0), (3, 2, 'K', 'u', 0), (0, 2, 'R', '', 1), (1, 2, 'R', '', 1), (2, 3, 'R', '', 1), (3, 2, 'R', '', 1)),
b(conv_id, n, state, v) as (select distinct conv_id, cast(0 as bigint), 0, struct_pack(cost := cast(0 as bigint), audit := '') from f
  union all select b.conv_id, b.n + 1, nxt, min(struct_pack(cost := cast(v.cost + 5 * k + price + case when letter <> 'D' and fault = 1 then 5 else 0 end as bigint), audit := concat(v.audit, repeat('I', k), letter)))
  from b join f on f.conv_id is not distinct from b.conv_id and f.n = b.n + 1 join ins on ins.f = b.state join act on act.t = ins.t and (letter = 'D' or fault < 2 and (letter = 'R' or sym = i)) group by b.conv_id, b.n + 1, nxt),
z as (select b.conv_id, min(struct_pack(cost := cast(v.cost + 5 * k as bigint), audit := concat(v.audit, repeat('I', k)))) as v from b join (select conv_id, max(n) as n from f group by 1) m on m.conv_id is not distinct from b.conv_id and m.n = b.n join ins on ins.f = b.state where ins.t in (0, 3) group by 1),
e as (select conv_id, v.cost as cost, v.audit as audit, unnest(range(1, length(v.audit) + 1)) as p from z),
g as (select conv_id, p, substr(audit, p, 1) as x, sum(case when substr(audit, p, 1) <> 'I' then 1 else 0 end) over (partition by conv_id order by p) as n, sum(case when substr(audit, p, 1) <> 'D' then 1 else 0 end) over (partition by conv_id order by p) as place, sum(case when substr(audit, p, 1) <> 'D' then 1 else 0 end) over (partition by conv_id) % 2 as headed from e),
y as (select g.conv_id, string_agg(concat(case when x = 'K' then f.role when (place - 1 - headed) % 2 = 0 then 'user' else 'assistant' end, ':', case when x = 'I' then '' else f.text end), chr(10) order by p) as text
  from g left join f on f.conv_id is not distinct from g.conv_id and f.n = g.n where x <> 'D' group by 1),
q as (select *, lag(i) over (partition by conv_id order by n) as before from f),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 2) as blank, count(*) filter (fault = 3) as duplicate, count(*) filter (fault = 1) as truncated, count(*) filter (n > 1 and concat(before, i) not in ('su', 'ua', 'au')) as illegal from q group by 1)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(z.v.cost, 0) as cost, coalesce(z.v.audit, '') as audit, sha256(coalesce(y.text, '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join c on c.conv_id is not distinct from a.conv_id left join z on z.conv_id is not distinct from a.conv_id left join y on y.conv_id is not distinct from a.conv_id"""

BASE_RULES_SQL = f"""with t as (select doc_id, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as w from documents), n as (select *, len(w) as n from t),
g as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i:i + 2], ' ')) as c from (select doc_id, w, unnest(range(1, n - 1)) as i from n where n >= 3)),
r as (select doc_id, count(distinct p) as n_repeat from (select doc_id, unnest(range(i, i + 3)) as p from g where c > 1) group by 1),
l as (select doc_id, line, row_number() over (partition by doc_id, line) as k from (select doc_id, unnest(string_split(text, chr(10))) as line from t) where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
d as (select doc_id, count(*) as n_dup from l where k > 1 group by 1)
select n.doc_id, n as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  coalesce(n_dup, 0) as n_dup_lines, coalesce(n_repeat, 0) as n_repeat_words, n < 50 or 100 * coalesce(n_repeat, 0) > 50 * n as base_failed from n left join r using (doc_id) left join d using (doc_id)"""
BASE_WORD_SCORES_SQL = f"""with t as (select doc_id, {_CRC.format("cast(doc_id as varchar)")} % 7 = 2 as held_out, {_WORDS.format(_LOWER)} as w from documents),
x as (select doc_id, held_out, unnest(list_append(w, '')) as word from t), c as (select word, count(*) as c from x where not held_out group by 1),
a as (select cast(sum(c) as bigint) as n, count(*) as v from c)
select doc_id, held_out, count(*) as n_tokens, count(c.c) as n_known, n as train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (n + 1e0 * (v + 1)))), 6) as base_score from x left join c using (word), a group by doc_id, held_out, n, v"""
MIXING_TARGETS_SQL = f"""with recursive s as (select source, cast(sum(len({_WORDS.format("coalesce(text, '')")})) as bigint) as size, row_number() over (order by source nulls last) - 1 as i from documents group by 1),
w as (select *, [3e0, 1e0, 2e0][i % 3 + 1] as w, 1.5e0 * sum(size) over () as due from s),
r(source, size, w, free, target, round, due) as (select source, size, w, true, least(2e0 * size, w * due / sum(w) over ()), 1, due from w
  union all select source, size, w, free and target < 2e0 * size, case when free and target < 2e0 * size then least(2e0 * size, target + w * (due - sum(target) over ()) / nullif(sum(case when free and target < 2e0 * size then w end) over (), 0)) else target end, round + 1, due from r where round < 60)
select source, size as source_size, round(target, 4) as target, true as near from r where round = 60"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    more = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {"op1_ngram_jaccard_join": OP1_SQL, "op8_substring_dedup": OP8_SQL, "op11_dataset_manifest": OP11_SQL, "op12_conversation_repair": OP12_SQL, "base_rules": BASE_RULES_SQL, "base_word_scores": BASE_WORD_SCORES_SQL, "mixing_targets": MIXING_TARGETS_SQL} | more
