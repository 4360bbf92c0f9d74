"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merrow.llm.shared import table

N_SHARDS = 24


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merrow.llm.decontaminate import find_benchmark_passages

    found = find_benchmark_passages(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merrow.llm.bpe import bpe_encode

    return bpe_digests(bpe_encode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), decoded_col="decoded", keep=["doc_id"]))


def bpe_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merrow.llm.language import held_out, identify, learn

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, learn(docs), keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _lines_left(left: DataFrame) -> DataFrame:
    return left.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.sha2("text", 256).alias("text_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of line dedup: chunks, and repeated passages whatever chunks they are in."""
    from merrow.llm.line_dedup import dedup_lines

    return _lines_left(dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"), passages=True))


def op4_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup by chunks alone, which SQL can state."""
    from merrow.llm.line_dedup import dedup_lines

    return _lines_left(dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merrow.llm.quality import judge

    return judge(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merrow.llm.secrets import KINDS, find_secrets, written_out

    found = find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("random"))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written_out(base), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from merrow.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merrow.llm.shards import shard_rows

    placed = shard_rows(table(spark, sf_dir, "documents", "doc_id", "text"), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merrow.llm.chat import calls_in, link_calls

    calls, results = calls_in(table(spark, sf_dir, "conversations"))
    linked = link_calls(calls, results)
    alone = F.when(F.col("status") == "no_call", F.col("content"))
    return linked.select("conv_id", "turn", "call_id", "name", "level", "status", "n_results", "valid", F.array_join("errors", "; ").alias("errors"), "message", "result_turn", alone.alias("content"))


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merrow.llm.near_copies import link_near_copies

    return link_near_copies(table(spark, sf_dir, "documents", "doc_id", "text"), size=3, num=90, den=100)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merrow.llm.resample import resample

    drawn = resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"), keep=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merrow.llm.repeats import remove_repeats

    left = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merrow.llm.vector_codes import compress, hex_codes

    coded = compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", hex_codes(F.col("codes")).alias("code"), "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_bpe": op2_bpe,
    "op3_language": op3_language,
    "op4_line_dedup": op4_line_dedup,
    "op4_chunks": op4_chunks,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_token_counts": op7_token_counts,
    "op8_shards": op8_shards,
    "op9_chat": op9_chat,
    "op10_near_copies": op10_near_copies,
    "op11_resample": op11_resample,
    "op12_repeats": op12_repeats,
    "op13_vector_codes": op13_vector_codes,
}

def _codes_sql() -> str:
    """Two rounds that move the entries, and a last assignment."""
    nearest = """
near{r} as materialized (
  select no, part, (min(d * 64 + entry) % 64)::int as entry, min(d) as d from (
    select p.no, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from part p join book{r} b on b.part = p.part) group by no, part
)"""
    moved = """
book{s} as materialized (
  select b.part, b.entry, coalesce(m.x, b.x) as x from book{r} b left join (
    select part, entry, list(mean order by i) as x from (
      select n.part, n.entry, i, floor(sum(p.x[i]) / count(*))::bigint as mean
      from near{r} n join part p using (no, part), range(1, 1 + (select max(width) from kept)) k(i) group by all) group by part, entry
  ) m on m.part = b.part and m.entry = b.entry
)"""
    return f"""
with kept as materialized (
  select row_number() over (order by vec_id) as no, vec_id, label, len(embedding) // 16 as width,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), part as materialized (
  select no, part, v[part * width + 1 : (part + 1) * width] as x from kept, range(16) p(part)
), book0 as (
  select part, (no - 1)::int as entry, x from part where no <= 64
),{nearest.format(r=0)},{moved.format(r=0, s=1)},{nearest.format(r=1)},{moved.format(r=1, s=2)},{nearest.format(r=2)}, coded as (
  select no, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from near2 group by no
), digest as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from book2
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded join kept using (no), digest
"""


ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": """
with doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), item_word as (
  select item_id, unnest(w) as word, generate_subscripts(w, 1) as i, len(w) as n, least(13, len(w)) as size from item where len(w) > 0
), win as (
  select distinct item_id, size, g from (
    select item_id, size, n, i, string_agg(word, ' ') over (partition by item_id order by i rows between current row and 12 following) as g from item_word) where i <= n - size + 1
), word as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from doc
), next as (
  select doc_id, i, list(word) over (partition by doc_id order by i rows between current row and 12 following) as a from word
), found as (
  select n.doc_id, n.i, s.size, array_to_string(a[1:s.size], ' ') as g from next n, (select distinct size from win) s where len(a) >= s.size
), hit as (
  select doc_id, i, f.size, item_id from found f join win on win.size = f.size and win.g = f.g
), counted as (
  select doc_id, count(distinct i + k) as n_hit from hit, range(13) r(k) where k < size group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc d left join counted c on c.doc_id = d.doc_id left join named n on n.doc_id = d.doc_id
""",
    "op4_chunks": """
with line as (
  select doc_id, i, string_split(text, chr(10))[i] as line
  from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)
), marked as (
  select *, ('0x' || substr(md5(line), 1, 7))::bigint as h, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 50 as long
  from line
), started as (
  select *, case when i = 1 or long or lag(long) over w or (31 * lag(h) over w + h) % 3 = 0 then 1 else 0 end as starts
  from marked window w as (partition by doc_id order by i)
), numbered as (
  select *, sum(starts) over (partition by doc_id order by i) as chunk from started
), chunk as (
  select doc_id, chunk, count(*) as lines, string_agg(line, chr(10) order by i) as body, bool_or(long) as long
  from numbered group by all
), repeatable as (
  select *, (lines > 1 or long) and regexp_matches(body, '[^\\x20\\x09-\\x0D]') as may_go from chunk
), decided as (
  select *, may_go and row_number() over (partition by body, may_go order by doc_id, chunk) > 1 as gone from repeatable
)
select d.doc_id, sum(lines)::bigint as n_lines, count(*) as n_chunks, count(*) filter (gone) as n_removed_chunks,
  coalesce(sum(lines) filter (gone), 0)::bigint as n_removed_lines,
  sha256(coalesce(string_agg(body, chr(10) order by chunk) filter (not gone), '')) as text_sha256
from decided d group by d.doc_id
""",
    "op5_quality": """
with doc as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), word as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from doc
), win as (
  select doc_id, i, word || ' ' || lead(word, 1) over p || ' ' || lead(word, 2) over p as g from word window p as (partition by doc_id order by i)
), again as (
  select doc_id, i from win where g is not null qualify count(*) over (partition by doc_id, g) > 1
), covered as (
  select doc_id, count(distinct i + k) as n from again, (values (0), (1), (2)) as s(k) group by doc_id
), line as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as line from doc
), normal as (
  select doc_id, source, text, line, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as n from line where regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), common as (
  select source, n from normal group by source, n having count(distinct doc_id) > 20
), per_doc as (
  select m.doc_id, count(*) - count(distinct line) as n_dup_lines,
    coalesce(sum(len(string_split(m.n, ' '))) filter (c.n is not null), 0) as n_common_words
  from normal m left join common c on m.source is not distinct from c.source and m.n = c.n group by m.doc_id
), facts as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(p.n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(p.n_common_words, 0)::bigint as n_common_words
  from doc d left join covered c using (doc_id) left join per_doc p using (doc_id)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * (n_words - n_common_words) >= 50 * n_words as kept
from facts
""",
    "op11_resample": """
with recursive step(n, i, c) as (
  select n, 0, n from range(256) r(n)
  union all
  select n, i + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where i < 8
), crc as (
  select list(c order by n) as t from step where i = 8
), doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), item as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), raw as (
  select doc_id, word, count(*) as n from (select doc_id, unnest(w) as word from doc) group by all
), target as (
  select word, count(*) as n from (select unnest(w) as word from item) group by all
), word as (
  select word, hex(encode(word)) as h from (select word from raw union select word from target)
), bytes as (
  select word, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::bigint) as b from word
), hashed as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from bytes, crc
), raw_bucket as (
  select bucket, sum(n)::double as s from raw join hashed using (word) group by bucket
), target_bucket as (
  select bucket, sum(n)::double as t from target join hashed using (word) group by bucket
), whole as (
  select (select coalesce(sum(s), 0) from raw_bucket) as s_all, (select coalesce(sum(t), 0) from target_bucket) as t_all
), gain as (
  select h.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((coalesce(s, 0) + 1) * (t_all + 10000))))::bigint as gain
  from (select distinct bucket from hashed) h left join raw_bucket r on r.bucket = h.bucket left join target_bucket g on g.bucket = h.bucket, whole
), weighed as (
  select doc_id, sum(n * gain)::bigint as weight from raw join hashed using (word) join gain using (bucket) group by doc_id
), scored as (
  select d.doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from doc d left join weighed using (doc_id)
), placed as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 20
)
select s.doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end as rank from scored s left join placed using (doc_id)
""",
    "op12_repeats": """
with doc as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), win as (
  select doc_id, p, substr(h, 2 * p + 1, 200) as w from (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) as p from doc)
), again as (
  select doc_id, p from win qualify row_number() over (partition by w order by doc_id, p) > 1
), marked as (
  select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 100 then 1 else 0 end as fresh from again
), run as (
  select doc_id, min(p) as a, max(p) + 100 as b from (select *, sum(fresh) over (partition by doc_id order by p) as r from marked) group by doc_id, r
), gap as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a0, a as b0, a, b from run
), whole as (
  select doc_id, sum(b - a) as gone, count(*) as spans, max(b) as last, string_agg(substr(h, 2 * a0 + 1, 2 * (b0 - a0)), '' order by a) as body
  from gap join doc using (doc_id) group by doc_id
)
select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(body, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from doc d left join whole using (doc_id)
""",
    "op13_vector_codes": _codes_sql(),
}
