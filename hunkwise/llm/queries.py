"""The operators of this subpackage as queries over their whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.llm import cleaning, licenses, secrets
from hunkwise.llm.alignment import align
from hunkwise.llm.cleaning import clean
from hunkwise.llm.maxscore import quantised, top_k
from hunkwise.llm.minhash import near_duplicates
from hunkwise.llm.packing import pack
from hunkwise.llm.quality import quality_scores
from hunkwise.llm.resampling import resample
from hunkwise.llm.sharding import shards
from hunkwise.llm.toxicity import toxicity_scores
from hunkwise.llm.urls import judge
from hunkwise.llm.winnowing import contamination

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("vector"))
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), path="source")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Host and path rules of the URL filter.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), URL_RULES).drop("score")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, per_100=80)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents"), texts=False).drop("clean_text")


QUERIES: dict[str, Query] = {
    "op1_maxscore": op1_maxscore,
    "op2_packing": op2_packing,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_urls": op5_urls,
    "op6_licenses": op6_licenses,
    "op7_sharding": op7_sharding,
    "op8_winnowing": op8_winnowing,
    "op9_quality": op9_quality,
    "op10_minhash": op10_minhash,
    "op11_alignment": op11_alignment,
    "op12_resampling": op12_resampling,
    "op13_cleaning": op13_cleaning,
}

#: A-Z alone are lower-cased, as in the operator.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: Labelled URLs that a model of op5 counts: t without the held fold, f with it; 0 rejected, 1 accepted.
_URL_MODELS = {"t0": "action = 'block' and not held", "t1": "action = 'allow' and not held", "f0": "action = 'block'", "f1": "action = 'allow'"}
_URL_COUNTS = ", ".join(f"count(*) filter ({rows}) as {m}" for m, rows in _URL_MODELS.items())


def _url_level(k: int) -> str:
    """Probabilities of bytes after k others; a byte is two signs of a gram."""
    sums, of = (", ".join(f(m) for m in _URL_MODELS) for f in (lambda m: f"sum({m}) as {m}", lambda m: f"{m}, sum({m}) over (partition by left(gram, {2 * k})) as of_{m}"))
    mixed = ", ".join(f"({m} + 2.0::double * {f'p_{m}' if k else '(1 / 256.0::double)'}) / (of_{m} + 2.0::double) as p_{m}" for m in _URL_MODELS)
    below = f"join (select gram as shorter, {', '.join(f'p_{m}' for m in _URL_MODELS)} from mixed{k - 1}) y on right(x.gram, {2 * k}) = shorter" if k else ""
    return f"mixed{k} as materialized (select gram, {mixed} from (select gram, {of} from (select right(gram, {2 * k + 2}) as gram, {sums} from seen group by 1)) x {below})"


_URL_LEVELS = ",\n".join(_url_level(k) for k in range(5))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLE_SQL: dict[str, str] = {
    "op1_maxscore": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
""",
    "op5_urls": f"""
with crc_table as (
  select list_transform(range(256), lambda c: list_reduce(range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, c)) as crcs
), p as (
  select row_number() over () as row, page_id, coalesce(url, '') as url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages
), parts as (
  select row, page_id, url, hex(encode(url)) as h,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from p
), rules(action, rule) as (values ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
fits as (
  select row, max_by(rule, length(rule)) as rule, max_by(action, length(rule)) as action
  from parts join rules on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1)))
    and starts_with(path, substr(rule, strpos(rule, '/')))
  group by row
), u as materialized (
  select row, page_id, url, host, path, rule, action, h, xor(list_reduce(
    list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint),
    lambda c, x: xor(crcs[(xor(c, x) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295) % 5 = 0 as held
  from parts left join fits using (row), crc_table
), grams as materialized (
  select row, action, held, substr('........' || h, 2 * i + 1, 10) as gram from u, unnest(range(length(h) // 2)) t(i)
), seen as materialized (
  select gram, {_URL_COUNTS} from grams group by gram
), {_URL_LEVELS},
ratio as (select gram, ln(p_t1 / p_t0) as trial, ln(p_f1 / p_f0) as ratio from mixed4),
means as materialized (select row, avg(trial) as trial, avg(ratio) as score from grams join ratio using (gram) group by row),
cells as (
  select action, floor(greatest(-10, least(10, coalesce(trial, 0))) / 0.01::double)::int as cell, count(*) as n
  from u left join means using (row) where held and action is not null group by all
), curve as (
  select k, sum(n) filter (cell < k and action = 'block') as b, sum(n) filter (cell < k and action = 'allow') as a from range(-1000, 1002) t(k), cells group by k
), totals as (select sum(n) filter (action = 'block') as b, sum(n) filter (action = 'allow') as a from cells),
gains as (select k, coalesce(curve.b, 0) / totals.b - coalesce(curve.a, 0) / totals.a as gain from curve, totals),
best as (select coalesce((min(k) + max(k)) / 2 * 0.01::double, 0) as cut from gains where gain >= (select max(gain) from gains) - 1e-12)
select page_id, host, path, rule, coalesce(action, case when coalesce(score, 0) >= cut then 'allow' else 'block' end) as verdict
from u left join means using (row), best
""",
    "op8_winnowing": f"""
with d as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
bw as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') as win
  from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) where len(w) > 0
), sizes as (select distinct n from bw),
dw as (
  select row, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as win
  from d, sizes, unnest(range(1, len(w) - n + 2)) t(i) where len(w) >= n
), hit as (select row, i, dw.n, item_id from dw join bw using (win)),
per as (
  select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + n)) as p from hit) group by row
), items as (select row, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join per using (row) left join items using (row)
""",
    # prefixes of the rarest shingles find every candidate pair; full sets decide
    "op10_minhash": """
with recursive d as (
  select row_number() over () as row, doc_id::bigint as doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') as w
  from documents
), sets as (
  select row, doc_id, case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from d
), classes as materialized (
  select min(doc_id) as node, list_sort(s) as s from sets where len(s) > 0 and doc_id is not null group by list_sort(s)
), words as materialized (select node, len(s) as n, unnest(s) as shingle from classes),
ordered as (
  select node, n, shingle, row_number() over (partition by node order by f, shingle) as pos
  from words join (select shingle, count(*) as f from words group by shingle) using (shingle)
), prefix as materialized (select node, n, shingle from ordered where pos <= n - (80 * n + 99) // 100 + 1),
pairs as (
  select distinct a.node as a, b.node as b, a.n as n_a, b.n as n_b
  from prefix a join prefix b on a.shingle = b.shingle and a.node < b.node and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n
), links as materialized (
  select p.a, p.b from pairs p join classes x on x.node = p.a join classes y on y.node = p.b
  where 100 * len(list_intersect(x.s, y.s)) >= 80 * (n_a + n_b - len(list_intersect(x.s, y.s)))
), reach as (
  select node, node as other from classes
  union
  select r.node, case when l.a = r.other then l.b else l.a end from reach r join links l on r.other in (l.a, l.b)
), component as (select node, min(other) as component_id from reach group by node)
select sets.doc_id, len(sets.s)::bigint as n_shingles, coalesce(component_id, sets.doc_id) as component_id,
  sets.doc_id is not distinct from coalesce(component_id, sets.doc_id) as kept
from sets left join classes on list_sort(sets.s) = classes.s and sets.doc_id is not null left join component using (node)
""",
    "op12_resampling": f"""
with crc_table as (
  select list_transform(range(256), lambda c: list_reduce(range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, c)) as crcs
), d as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
b as (select {_WORDS} as w from benchmark),
words as (select distinct unnest(w) as word from d union select distinct unnest(w) from b),
hashed as (
  select word, xor(list_reduce(
    list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint),
    lambda c, x: xor(crcs[(xor(c, x) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295) % 10000 as bucket
  from words, crc_table
), dw as (select row, unnest(w) as word from d), bw as (select unnest(w) as word from b),
s as (select bucket, count(*) as n from dw join hashed using (word) group by bucket),
t as (select bucket, count(*) as n from bw join hashed using (word) group by bucket),
gains as (
  select k.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * ((select coalesce(sum(n), 0) from s)::double + 10000)
    / ((coalesce(s.n, 0) + 1.0::double) * ((select coalesce(sum(n), 0) from t)::double + 10000))))::bigint as gain
  from range(10000) k(bucket) left join s on s.bucket = k.bucket left join t on t.bucket = k.bucket
), per as (select row, sum(gain)::bigint as weight from dw join hashed using (word) join gains using (bucket) group by row),
scored as (
  select row, doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from d left join per using (row)
), able as (select row, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * (select count(*) from able) // 100 then rank end as rank
from scored left join able using (row)
""",
    "op13_cleaning": f"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') as w from documents),
split as (select row, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line from d),
lines as (
  select *, regexp_extract_all(line, '[^ \\t-\\r]+') as words, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
    row_number() over (partition by row, line order by pos) > 1 as again from split where regexp_matches(line, '[^ \\t-\\r]')
), judged as (
  select row, length(array_to_string(words, '')) as chars, len(regexp_extract_all(line, {_quoted(cleaning.SYMBOLS)})) as signs, again,
    again or 5 * signs > len(words) or 5 * len(regexp_extract_all(line, {_quoted(cleaning.SHOUTS)})) > len(words)
    or not ends and 25 * len(regexp_extract_all(line, {_quoted(cleaning.SENTENCE_MARKS)})) < len(words)
    or len(regexp_extract_all(line, {_quoted(cleaning.SEPARATORS)})) >= 2
    or not ends and len(words) <= {cleaning.MENU_WORDS} and regexp_matches(low, {_quoted(cleaning.MENU)})
    or regexp_matches(low, {_quoted(cleaning.BOILERPLATE)}) as fails
  from (select *, regexp_matches(line, {_quoted(cleaning.SENTENCE_END)}) as ends from lines)
), per as (
  select row, sum(chars) as chars, sum(signs) as signs, count(*) filter (again) as repeats, count(*) filter (fails) as failed, coalesce(sum(chars) filter (fails), 0) as lost
  from judged group by row
), windows as (select row, i, array_to_string(w[i:i + 7], ' ') as win from d, unnest(range(1, len(w) - 6)) t(i) where len(w) >= 8),
twice as (select row, i from windows join (select row, win from windows group by all having count(*) > 1) using (row, win)),
repeated as (select row, count(distinct p) as n from (select row, unnest(range(i, i + 8)) as p from twice) group by row),
figures as (
  select doc_id, len(w)::bigint as n_words, coalesce(chars, 0)::bigint as word_chars, coalesce(signs, 0)::bigint as n_symbols, coalesce(repeats, 0)::bigint as n_dup_lines,
    coalesce(repeated.n, 0)::bigint as n_repeat_words, coalesce(failed, 0)::bigint as n_failed_lines, coalesce(lost, 0)::bigint as lost_chars
  from d left join per using (row) left join repeated using (row)
)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * lost_chars <= {cleaning.MOST_LOST} * word_chars as kept
from figures
""",
}
