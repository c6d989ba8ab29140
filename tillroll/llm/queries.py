"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tillroll.llm import (decontaminate, hyperminhash, importance, langid, line_dedup, mips, orc_tokens, packing, setjoin, spelling, substring,
                          token_scan, toolcalls)
from tillroll.llm.ship import ship
from tillroll.sources.stage import scratch_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens of every document in the token files."""
    folder = scratch_path(spark, "token-files")
    order = token_scan.write(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"))
    return token_scan.token_counts(order, folder)


def op2_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orc-tokens")
    orc_tokens.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1, added=True)
    return orc_tokens.digests(spark, path)


def op3_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    told = langid.predict(docs.select("doc_id", "text"), model)
    return told.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


SCHEMAS = [("search", ["query"], {"query": "STRING", "limit": "BIGINT"}), ("lookup", ["id"], {"id": "BIGINT"}),
           ("note", ["query", "done"], {"query": "STRING", "done": "BOOLEAN"})]


def tool_tables(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of conversation turns: every user turn calls a tool with its text, and
    the assistant turn behind it is the result. Neighbouring calls depend on each other in a
    direction given by the text's length, so that both orders occur."""
    n, call = F.coalesce(F.length("text"), F.lit(0)), lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    tool = F.element_at(F.array(*[F.lit(x[0]) for x in SCHEMAS], F.lit("retired")), (n % 4 + 1).cast("int"))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), F.when(n % 3 > 0, n % 50).alias("limit"), F.when(n % 4 == 1, F.col("conv_id")).alias("id"), F.when(n % 5 > 0, n % 2 == 0).alias("done")))
    user, turn = turns.where("role = 'user'"), F.col("turn")
    ahead = F.when(n % 2 == 0, F.array(call(turn + 2))).otherwise(F.array().cast("array<string>"))
    calls = user.select("conv_id", call(turn).alias("call_id"), turn.alias("pos"), tool.alias("name"), arguments.alias("arguments"), ahead.alias("depends_on"))
    back = user.where(n % 2 == 1).select("conv_id", call(turn + 2).alias("call_id"), call(turn).alias("dep")).distinct()
    known = user.select("conv_id", call(turn).alias("dep")).distinct()
    # a dependency on a turn that is not there is left out
    calls = (calls.join(back, ["conv_id", "call_id"], "left").withColumn("dep2", F.try_element_at("depends_on", F.lit(1)))
             .join(known.withColumnsRenamed({"dep": "dep2"}).withColumn("there", F.lit(True)), ["conv_id", "dep2"], "left"))
    depends = F.expr("filter(array(dep, if(there, dep2, null)), x -> x is not null)")
    calls = calls.select("conv_id", "call_id", "pos", "name", "arguments", depends.alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", call(turn - 1).alias("call_id"), turn.alias("pos"), F.col("text").alias("content"))
    return calls, results


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_tables(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(SCHEMAS, "name string, required array<string>, types map<string, string>")
    return toolcalls.link(calls, results, schemas)


def op5_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op6_prefix_filtered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digests(decontaminate.mark(docs, table(spark, sf_dir, "benchmark")))


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), added=True))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.group(table(spark, sf_dir, "documents"), k=2, percent=80)


def op11_set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.group(table(spark, sf_dir, "documents"), k=3, percent=90)


def op12_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10)


QUERIES = {f.__name__: f for f in (op1_separator_scan, op2_orc_tokens, op3_nearest_centroid, op4_tool_call_linking, op5_norm_buckets, op6_prefix_filtered_join, op7_fm_index, op8_line_runs, op9_min_bin_slack, op10_hyperminhash, op11_set_relations, op12_trie_pairs, op13_importance_resampling)}

_OP8_SQL = r"""
with lines as (
  select doc_id, t.pos, t.line, translate(trim(t.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from documents, unnest(list_zip(string_split(coalesce(text, ''), chr(10)), range(1, 1 + len(string_split(coalesce(text, ''), chr(10)))))) as u(z),
       lateral (select z[1] as line, z[2] as pos) as t),
firsts as (select key, min(doc_id) as first_doc from lines where length(key) >= 10 group by key),
judged as (select l.doc_id, l.pos, l.line, f.key is not null and f.first_doc < l.doc_id as gone from lines l left join firsts f on l.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""

_OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
           from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""

#: crc32 of every distinct ``x`` of a CTE ``keys``, byte by byte from a table made by its rule.
_CRC_SQL = """
tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
crcs as (select x, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(x)), lambda i: ('0x' || substr(hex(encode(x)), (2 * i + 1)::bigint, 2))::bigint)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc from (select distinct x from keys), tab)
"""

_OP13_SQL = f"""
with words as (select doc_id, 'd' as side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as x from documents
  union all select null, 'b', unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) from benchmark),
keys as (select x from words), {_CRC_SQL},
features as (select doc_id, side, crc % 10000 as bucket from words join crcs using (x)),
totals as (select count(*) filter (where side = 'd') as s_all, count(*) filter (where side = 'b') as t_all from features),
gains as (select bucket, floor(1000 * ln((count(*) filter (where side = 'b') + 1)::double * (s_all + 10000)::double / ((count(*) filter (where side = 'd') + 1)::double * (t_all + 10000)::double)))::bigint as gain
          from features, totals group by bucket, s_all, t_all),
weights as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from features join gains using (bucket) where side = 'd' group by doc_id),
scored as (select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0)::bigint as weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from documents d left join weights w on d.doc_id = w.doc_id),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as able from scored where n_features >= 20)
select s.doc_id, s.n_features, s.weight, s.score, case when rank <= 10 * able // 100 then rank end as rank from scored s left join drawn using (doc_id)
"""

_OP12_SQL = f"""
with recursive runs as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as c
  from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as r from documents) group by all),
keys as (select doc_id || ':' || run as x from runs where length(run) >= 5), {_CRC_SQL},
seen as (select case when crc % 97 = 0 then run[1:(crc % length(run))::bigint] || run[(crc % length(run) + 2)::bigint:] else run end as word, c from runs join crcs on x = doc_id || ':' || run),
words as (select word, sum(c)::bigint as n from seen where length(word) >= 5 group by word having sum(c) >= 3),
cuts as (select word, n, unnest(range(length(word)))::bigint as i from words),
less as (select word, n, i, word[1:i] as ahead, word[i + 2:] as behind from cuts),
near as (select a.word, a.n, b.word as other, b.n as m from less a join less b on a.i = b.i and a.ahead = b.ahead and a.behind = b.behind and a.word <> b.word
  union select a.word, a.n, w.word, w.n from less a join words w on w.word = a.ahead || a.behind
  union select w.word, w.n, a.word, a.n from less a join words w on w.word = a.ahead || a.behind),
best as (select word, count(*) as n_near, max(m) as most, arg_min(other, (-m, encode(other))) as other from near group by word),
judged as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 2 * w.n then other end as form, case when most >= 2 * w.n then most end as form_n from words w left join best b on w.word = b.word),
chain(word, last) as (select word, word from judged union all select c.word, j.form from chain c join judged j on j.word = c.last where j.form is not null),
ends as (select c.word, c.last as root from chain c join judged j on j.word = c.last where j.form is null)
select j.word, form, root, n, n_near, form_n from judged j join ends using (word)
"""

_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP6_SQL = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select distinct item_id::varchar as item, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
wins as (select distinct item, w[i:least(i + 9, len(w))] as win from (select item, w, unnest(range(1, 1 + greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
places as (select doc_id, m, i, w[i:i + m - 1] as win from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct len(win) as m from wins) where len(w) >= m)),
hits as (select doc_id, i, m, item from places join wins using (win)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join found using (doc_id)
"""

_OP7_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
wins as (select doc_id, i, w[i:i + 19] as win from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as nth from wins) where nth > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from again),
words as (select doc_id, unnest(w) as word, unnest(range(1, 1 + len(w))) as p from d),
kept as (select doc_id, count(*) as n_kept, string_agg(word, ' ' order by p) as text from words anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256 from d left join kept k using (doc_id)
"""


def _jaccard_sql(k: int, percent: int, more: str = "") -> str:
    """Components of documents by the similarity of their sets of ``k``-word shingles."""
    return rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER_SQL}, '[^\x20\x09-\x0D]+') as w from documents),
sets as (select distinct doc_id, array_to_string(w[i:i + {k - 1}], ' ') as x from (select doc_id, w, unnest(range(1, 1 + greatest(len(w) - {k - 1}, 1))) as i from d where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from sets a join sets b on a.x = b.x and a.doc_id <> b.doc_id group by all),
links as (select a, b from pairs join sizes s on s.doc_id = a join sizes t on t.doc_id = b where 100 * common >= {percent} * (s.n + t.n - common)),
reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id{more} from least left join sizes using (doc_id)
"""


ORACLE_SQL: dict[str, str] = {
    "op5_norm_buckets": _OP5_SQL, "op6_prefix_filtered_join": _OP6_SQL, "op7_fm_index": _OP7_SQL, "op8_line_runs": _OP8_SQL,
    "op10_hyperminhash": _jaccard_sql(2, 80, ", component_id = doc_id as kept"), "op11_set_relations": _jaccard_sql(3, 90),
    "op12_trie_pairs": _OP12_SQL, "op13_importance_resampling": _OP13_SQL}
