"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_and_decode
from .chat import read_back, write_formatted
from .hnsw import search
from .lexical import search as ranked_search
from .lines import dedup_lines
from .lzprint import edit_likeness
from .packing import pack_documents
from .quality import quality_scores
from .repair import repair
from .simhash import near_duplicates
from .substrings import dedup_substrings
from .tokencounts import token_counts
from .tokenfile import encoded_checksums


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(write_formatted(turns))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", F.col("n_removed_lines").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, width=13).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_checksums(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    decimals = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_chat, op3_neighbours, op4_lines, op5_quality, op6_packing, op7_substrings, op8_tokenfile, op9_bpe, op10_fingerprints,
                                    op11_repair, op12_token_counts, op13_search)}


CHAT_SQL = r"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) p(conv_id, turn, role, text)),
sized as (select *, length(role) + length(text) + 14
    + length(text) - length(replace(text, '\', '')) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, ':', ''))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 + (length(role) - length(replace(role, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text || ' ' || role, '#{3,}'), lambda x: length(x) - 2)), 0) as n from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, sum(n)::bigint as formatted_chars
from sized group by conv_id"""

SUBSTRINGS_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, md5(array_to_string(list_slice(ws, i, i + 12), ' ')) as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d)),
low as (select k, min(doc_id) as first from win group by k),
gone as (select distinct doc_id, i + unnest(range(0, 13)) as i from win join low using (k) where first < doc_id),
word as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from d)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(x.n, 0)::bigint as n_removed, sha256(coalesce(x.kept, '')) as kept_sha256
from d left join (select word.doc_id, count(gone.i) as n, string_agg(w, ' ' order by word.i) filter (where gone.i is null) as kept
    from word left join gone on word.doc_id = gone.doc_id and word.i = gone.i group by word.doc_id) x on d.doc_id = x.doc_id"""


def _repair_sql() -> str:
    """The repair as a table of least (cost, audit) per place and state, from the last row to the first; CRC-32 bit by bit."""
    crc = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::bigint)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"""

    def option(cost: str, letter: str, to: str, line: str | None = None, when: str = "true") -> str:
        text = f"{line} || chr(10) || {to}.r" if line else f"{to}.r"
        return f"case when {when} and {to} is not null then {{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 'r': {text}}} end"

    following = {0: 2, 1: 2, 2: 3, 3: 2}
    names = {2: "'user:'", 3: "'assistant:'"}
    step = []
    for s in range(4):
        keeps = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[s]
        kept = [option("cut", "K", f"b{to}", "role || ':' || text", f"stays and initial = '{i}'") for i, to in keeps]
        step.append(f"list_min([{', '.join([option('3', 'D', f'b{s}'), option('2 + cut', 'R', f'b{following[s]}', names[following[s]] + ' || text', 'stays'), *kept])}]) as n{s}")
    rounds = "select dp.conv_id as conv_id, i - 1 as i, " + ", ".join(step) + " from dp join row on row.conv_id is not distinct from dp.conv_id and nth = i"
    for _ in range(3):
        rounds = "select conv_id, i, " + ", ".join(f"list_min([n{s}, {option('2', 'I', f'n{following[s]}', names[following[s]])}]) as n{s}" for s in range(4)) + f" from ({rounds})"
    return f"""
with recursive hit as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as fate
    from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations)),
damaged as (select conv_id, turn, case when fate = 4 then 'user' else role end as role, case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when fate = 3 then 2 else 1 end)) as copy from hit where fate <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as nth, substr(role, 1, 1) as initial,
    not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again from damaged),
row as (select *, not blank and not again as stays, (not blank and not again and not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$'))::int as cut,
    lag(initial) over (partition by conv_id order by nth) || initial as pair from numbered),
facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate,
    sum(cut)::bigint as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal, count(*) as n from row group by 1),
dp as (select conv_id, n as i, {{'c': 0, 'a': '', 'r': ''}} as b0, {{'c': 4, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}} as b1, {{'c': 2, 'a': 'I', 'r': 'assistant:' || chr(10)}} as b2,
    {{'c': 0, 'a': '', 'r': ''}} as b3 from facts
    union all {rounds})
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    coalesce(b0.c, 0)::bigint as cost, coalesce(b0.a, '') as audit, sha256(coalesce(b0.r[:-2], '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join facts f on f.conv_id is not distinct from o.conv_id left join dp on dp.conv_id is not distinct from o.conv_id and i = 0"""


FOUND = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term"
SEARCH_SQL = f"""
with t as (select r, doc_id, {FOUND} from (select *, row_number() over () as r from documents)), n as (select r, count(*) as n from t group by 1), s as (select count(*) as docs, sum(n)::bigint as terms from n),
q as (select distinct item_id, {FOUND} from benchmark),
p as (select r, any_value(doc_id) as doc_id, term, count(*) as tf from t where term in (select term from q) group by r, term),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from p, s group by term),
x as (select item_id, r, any_value(doc_id) as doc_id, sum(w * (1000000000 * tf // (1000 * tf + 8 * (10 + 90 * n * docs // terms))))::bigint as score
    from q join p using (term) join w using (term) join n using (r), s group by item_id, r)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from x where score > 0) where rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": CHAT_SQL, "op7_substrings": SUBSTRINGS_SQL, "op11_repair": _repair_sql(), "op13_search": SEARCH_SQL}
