"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.storage import shared_dir
from skein.llm import bpe, codes, decontaminate, embeddings, exact_dedup, langid, lm_score, simhash, substring_dedup, toxicity, turns, url_filter, warc
from skein.llm.common import written

#: Rows whose crc32(id as text) mod 5 is 0 are held out of all training.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    both = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, decoded_col="decoded")
    numbers = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    return toxicity.train(docs.select("doc_id", "text"), labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_index(spark, path)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out("doc_id")))
    return langid.identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out documents count in the background only, and every document is scored by the counts of the others."""
    target = table(spark, sf_dir, "labels").where("quality = 1").where(~held_out("doc_id"))
    scored = lm_score.cross_entropy(table(spark, sf_dir, "documents"), target, leave_out=True)
    return scored.withColumn("held_out", held_out("doc_id"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns.damaged_repair(table(spark, sf_dir, "conversations"))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    text = F.array_join(F.transform("code", lambda k: F.lower(F.lpad(F.hex(k), 2, "0"))), "")
    found = codes.with_label_error(written(coded, "vector-codes"))
    return found.select("vec_id", text.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_groups(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_url_filter, op2_simhash, op3_byte_bpe, op4_decontaminate, op5_toxicity, op6_warc, op7_substring_dedup, op8_exact_dedup, op9_language_id, op10_lm_score, op11_conversation_repair, op12_vector_codes, op13_embedding_near_dedup)
    return {f.__name__: f for f in every}


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, {5 * k + 1}, 5))::BIGINT >> {s}) & 31)::INT, 1)" for k in range(8) for s in (15, 10, 5, 0))


def _add(state: str, cost: str | int, edit: str) -> str:
    return f"printf('%09d', left({state}, 9)::INT + {cost}) || substr({state}, 10) || '{edit}'"


#: crc32 bit by bit; then the cheapest edits of one more turn a round, each state a text of nine digits of cost and its edits (I, J: user, assistant inserted; R, S: made so).
_OP11 = f"""
with recursive b as (select dense_rank() over (order by conv_id nulls first) g, conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') t, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') k from conversations),
c as (select *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(k, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
lambda x, y: xor(xor(x, y) >> 1, (xor(x, y) & 1) * 3988292384)), 4294967295) % 20 m from b),
d as (select g, turn, case when m = 4 then 'user' else r end r, case m when 1 then '' when 2 then translate(t, '.!?', '') else t end t, unnest(case when m = 3 then [1, 2] else [1] end) copy from c where m <> 0),
e as (select *, rtrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) q, row_number() over (partition by g, r, t order by turn nulls first) nth, row_number() over (partition by g order by turn nulls first, r, t) i from d),
f as (select *, case when q = '' then 'B' when nth > 1 then 'D' when right(q, 1) not in ('.', '!', '?') then 'T' else ' ' end w, lag(r) over (partition by g order by i) p from e),
s as (select g, max(turn) - min(turn) + 1 - count(distinct turn) gaps, count(*) filter (w = 'B') blank, count(*) filter (w = 'D') duplicate, count(*) filter (w = 'T') truncated,
count(*) filter (p is not null and left(p, 1) || left(r, 1) not in ('su', 'ua', 'au')) illegal, count(*) n from f group by g),
z as (select distinct g, 0::BIGINT i, '000000000' n, '500000000' s, '000000003I' u, '000000006IJ' a from b
union all select g, i, n, s, u, least(a, {_add("u", 3, "J")}) from (select g, i, n, s, least(u, {_add("least(n, s, a)", 3, "I")}) u, a from (
select z.g, z.i + 1 i, {_add("n", 4, "D")} n, least({_add("s", 4, "D")}, case when k and left(r, 1) = 's' then {_add("n", "x", "K")} else '9' end) s,
least({_add("u", 4, "D")}, case when k then {_add("least(n, s, a)", "3 + x", "R")} else '9' end, case when k and left(r, 1) = 'u' then {_add("least(n, s, a)", "x", "K")} else '9' end) u,
least({_add("a", 4, "D")}, case when k then {_add("u", "3 + x", "S")} else '9' end, case when k and left(r, 1) = 'a' then {_add("u", "x", "K")} else '9' end) a
from z join (select g, i, r, w not in ('B', 'D') k, case when w = 'T' then 3 else 0 end x from f) f on f.g = z.g and f.i = z.i + 1))),
y as (select z.g, least(z.n, a) best from z left join s using (g) where i = coalesce(s.n, 0)),
o as (select y.g, i, regexp_extract_all(substr(best, 10), '[IJ]*[DKRS]')[i] x, r, t from y join f using (g)),
l as (select g, i, replace(replace(left(x, -1), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) || case right(x, 1) when 'D' then '' when 'K' then r || ':' || t || chr(10) when 'R' then 'user:' || t || chr(10) else 'assistant:' || t || chr(10) end x from o
union all select g, 1000000000, replace(replace(regexp_extract(substr(best, 10), '[IJ]*$'), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) from y),
h as (select g, string_agg(x, '' order by i) x from l group by g)
select conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0)::BIGINT blank, coalesce(duplicate, 0)::BIGINT duplicate, coalesce(truncated, 0)::BIGINT truncated, coalesce(illegal, 0)::BIGINT illegal,
left(best, 9)::BIGINT AS "cost", translate(substr(best, 10), 'JS', 'IR') audit, sha256(left(x, greatest(length(x) - 1, 0)::BIGINT)) repaired_sha256
from (select distinct g, conv_id from b) join y using (g) join h using (g) left join s using (g)"""


def _op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round as two named queries: the nearest entries of all parts, then the entries' floored means."""
    steps = [
        "k as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) v from embeddings "
        "where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        f"p as (select vec_id, part, list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts}) x from k, range({parts}) r(part))",
        f"b0 as (select part, e, x from (select part, row_number() over (partition by part order by vec_id) - 1 e, x from p) where e < {entries})",
    ]
    away = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for k in range(rounds + 1):
        steps.append(f"a{k} as materialized (select vec_id, part, s.e, s.d, x from (select p.vec_id, p.part, p.x, min({{'d': {away}, 'e': b.e}}) s from p join b{k} b using (part) group by all))")
        if k < rounds:
            mean = "((s - ((s % n) + n) % n) // n)::BIGINT"
            steps.append(
                f"m{k} as (select part, e, list(v order by c) x from (select part, e, c, {mean} v from (select part, e, c, sum(x[c])::BIGINT s, count(*) n from (select part, e, x, unnest(range(1, len(x) + 1)) c from a{k}) group by all)) group by all)"
            )
            steps.append(f"b{k + 1} as materialized (select part, e, coalesce(m.x, b.x) x from b{k} b left join m{k} m using (part, e))")
    return (
        "with " + ",\n".join(steps) + f""",
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, e)) codebooks_sha256 from b{rounds}),
c as (select vec_id, string_agg(printf('%02x', e), '' order by part) code, sum(d)::BIGINT AS "error" from a{rounds} group by vec_id)
select vec_id, code, "error", (sum("error") over (partition by label))::BIGINT label_error, codebooks_sha256 from c join k using (vec_id), h"""
    )


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": rf"""
with d as (select doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, list_slice(w, k, k + 9) x from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) k from i where len(w) > 0)),
sizes as (select distinct len(x) n from win),
occ as (select doc_id, n, k, list_slice(w, k, k + n - 1) x from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) k from d, sizes where len(w) >= n)),
m as (select doc_id, occ.n, k, item_id from occ join win using (x)),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(k, k + n)) p from (select distinct doc_id, n, k from m)) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) s from (select distinct doc_id, item_id::VARCHAR item_id from m) group by doc_id)
select doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (doc_id) left join its using (doc_id)""",
        "op6_warc": f"""
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) d, min(page_id) over (partition by coalesce(html, '')) f from pages)
select page_id, octet_length(encode(h))::BIGINT payload_bytes, {_BASE32} payload_digest,
case when page_id = f then 'response' else 'revisit' end record_type, case when page_id <> f then f end refers_to from p""",
        "op7_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
occ as (select doc_id, k, list_slice(w, k, k + 12) x from (select doc_id, w, unnest(range(1, len(w) - 11)) k from d where len(w) >= 13)),
f as (select doc_id, k, min(doc_id) over (partition by x) first from occ),
gone as (select doc_id, list(distinct p) g from (select doc_id, unnest(range(k, k + 13)) p from f where first < doc_id) group by doc_id)
select doc_id, len(w)::BIGINT n_words, coalesce(len(g), 0)::BIGINT n_removed,
sha256(array_to_string(case when g is null then w else list_filter(w, lambda x, i: not list_contains(g, i)) end, ' ')) kept_sha256
from d left join gone using (doc_id)""",
        "op8_exact_dedup": f"""
with d as (select doc_id, {_FOLD} t from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
doc_id = max(doc_id) over (partition by t) kept, sha256(t) text_sha256 from d""",
        "op11_conversation_repair": _OP11,
        "op12_vector_codes": _op12(),
        "op13_embedding_near_dedup": """
with recursive v as (select row_number() over () n, vec_id, embedding::DOUBLE[] e, label from embeddings),
k as (select * from v where label is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as materialized (select a.n, b.n m from k a join k b on a.label = b.label and a.n <> b.n and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select n, n m from v union select r.n, l.m from r join l on l.n = r.m),
c as (select r.n, min(v.vec_id) component_id from r join v on v.n = r.m group by r.n)
select vec_id, (select count(*) from l where l.n = v.n)::BIGINT n_links, component_id, vec_id = component_id kept from v join c using (n)""",
    }
