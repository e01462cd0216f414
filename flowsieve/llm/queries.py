"""Queries of this subpackage over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, jaccard, language, lines, lz, mixing, negatives, packing, rules, sharding, toxicity
from .workspace import Workspace, documents

N_SHARDS = 24
TOKENIZER = "byte_bpe_50k.json"
PACKING_TOKENIZER = "word_bpe_49k.json"


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)



def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", F.concat_ws(",", F.col("shards").cast("array<string>")).alias("shards"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), percent=80, width=5).select("doc_id", "n_shingles", "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"), F.concat_ws(",", F.col("keep_bitmap").cast("array<string>")).alias("keep_bitmap"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, sf_dir), [1.0] * N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.edited_likeness(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file(), decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.id_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    messages = chat.conversation_messages(rows.unionByName(own))
    messages = Workspace(spark, "messages").write(messages, "messages")
    made = chat.format_trees(messages, top=1)  # each root's best branch
    ids = messages.filter("parent is null").select(F.col("id").alias("root"), "conv_id")
    back = made.join(ids, "root").withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "rank",
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interaction_audit(audit.document_failures(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer_file(PACKING_TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_fingerprints": op8_fingerprints,
    "op9_bpe": op9_bpe,
    "op10_chat": op10_chat,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_packing": op13_packing,
}

_ESC = r"regexp_replace({}, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')"


SQL: dict[str, str] = {
    "op5_jaccard_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
g as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[(i + 1)::bigint:(i + 5)::bigint], ' ')) end) s from w),
n as (select doc_id, len(s)::bigint n_shingles from g),
x as (select doc_id, unnest(s) h from g),
c as (select a.doc_id a, b.doc_id b, count(*) common from x a join x b on a.h = b.h and a.doc_id <> b.doc_id group by all),
l as (select a, b from c join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * common >= 80 * (na.n_shingles + nb.n_shingles - common)),
r as (select doc_id a, doc_id b from n union select r.a, l.b from r join l on r.b = l.a)
select n.doc_id, n.n_shingles, min(r.b)::bigint component_id from n join r on n.doc_id = r.a group by all
""",
    "op6_line_dedup": r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) pos from d),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
h as (select k.*, f.key is not null hit from k left join f using (key)),
t as (select *, hit is distinct from lag(hit) over (partition by doc_id order by pos) turns from h),
g as (select doc_id, pos, hit, sum(turns::int) over (partition by doc_id order by pos) run from t),
r as (select doc_id, run, count(*) n, bool_or(hit) hit from g group by doc_id, run),
b as (select doc_id, string_agg(case when run = 1 and hit then '0,' else '' end || n, ',' order by run) keep_bitmap from r group by doc_id)
select doc_id, count(*)::bigint n_lines, (count(*) filter (where hit))::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not hit), '')) kept_sha256, any_value(b.keep_bitmap) keep_bitmap
from h join b using (doc_id) group by doc_id
""",
    "op7_sharding": r"""
with bits as (select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)) v from range(256) r(i)),
tab as (select list(v order by i) t from bits),
d as (select doc_id, coalesce(text, '') text, coalesce(doc_id::varchar, '') key from documents),
c as (select doc_id, key, text, hex(encode(text)) h from d),
s as (select doc_id, key, (strlen(text) + 8)::bigint size,
  xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(text)), lambda p: ('0x' || substr(h, (2 * p + 1)::bigint, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::bigint])))::bigint text_crc32,
  list_transform(range(25), lambda j: ('0x' || substr(md5('shard:' || j || ':' || key), 1, 13))::bigint) draws,
  ('0x' || substr(md5('slot:' || key), 1, 8))::bigint o
  from c, tab),
p as (select *, list_position(draws[1:24], list_max(draws[1:24])) - 1 shard, list_position(draws, list_max(draws)) - 1 grown_shard from s)
select doc_id, size, text_crc32, 'key' law, shard::int shard, (row_number() over (partition by shard order by o, doc_id, text_crc32, size) - 1)::bigint slot, grown_shard::int grown_shard from p
""",
    "op10_chat": r"""
with m as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
  coalesce(sum(length(t)) filter (where r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (where r = 'assistant'), '')) loss_sha256,
  sum(17 + length("""
    + _ESC.format(r"replace(replace(r, '\', '\\'), chr(10), '\n')")
    + ") + length("
    + _ESC.format("t")
    + r"""))::bigint formatted_chars, 1::int "rank"
from m group by conv_id
""",
    "op11_hard_negatives": r"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id a, b.vec_id b, a.l = b.l same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint s
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5)
select p.a anchor_id, p.b positive_id, (row_number() over (partition by p.a, p.b order by n.s desc, n.b))::int "rank", n.b negative_id, p.s positive_score, n.s negative_score
from p join s n on n.a = p.a and not n.same and 80 * p.s <= 100 * n.s and 100 * n.s <= 100 * p.s
qualify row_number() over (partition by p.a, p.b order by n.s desc, n.b) <= 5
""",
    "op12_filter_audit": r"""
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
f as (select doc_id, part, (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int m from d),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
c as (select part, m, count(*) n, count(*) filter (where good) good, count(*) filter (where toxic) toxic from f left join l using (doc_id) group by part, m),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) letter, unnest([1, 2, 4, 8, 16]) b),
o as (select x1.letter || x2.letter || x3.letter || x4.letter || x5.letter filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] bits
  from x x1, x x2, x x3, x x4, x x5 where (x1.b | x2.b | x3.b | x4.b | x5.b) = 31),
s as (select filter_order, step, bits[step] b, coalesce(list_sum(bits[1:step - 1]), 0)::int earlier from o, range(1, 6) r(step)),
r as (select part, filter_order, step, b,
  coalesce(sum(n) filter (where (m & (earlier | b)) = 0), 0) kept, coalesce(sum(n) filter (where (m & earlier) = 0 and (m & b) <> 0), 0) removed,
  coalesce(sum(n) filter (where (m & earlier) <> 0 and (m & b) <> 0), 0) redundant, coalesce(sum(n) filter (where m = b), 0) unique_fails,
  coalesce(sum(good) filter (where (m & earlier) = 0 and (m & b) <> 0), 0) good_lost, coalesce(sum(toxic) filter (where (m & earlier) = 0 and (m & b) <> 0), 0) toxic_lost
  from c, s group by part, filter_order, step, b)
select part, filter_order, step::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails,
  good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, b))::bigint shapley from r
""",
}
