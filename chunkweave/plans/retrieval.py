"""Retrieval over the chunk table, asked with the evaluation items, a table of fixed size."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chunkweave.operators import evaluate, links, retrieval
from chunkweave.plans._tables import CHUNKS, RELATIONS, TRIPLES, chunks, relations, strip_sql, triples
from chunkweave.runtime import table, written

_COLUMNS = ("kb_id", "content", "title", "search_text", "document_id", "source", "page", "chunk_index", "layer", "parent_id", "related_ids", "is_image_chunk")


def _chunks(spark, sf_dir):
    return chunks(spark, sf_dir, *_COLUMNS)


def _queries(spark, sf_dir):
    items = table(spark, sf_dir, "eval_records")
    return items.select(F.col("id").alias("query_id"), F.col("kb_id").alias("group"), F.coalesce("query", F.lit("")).alias("text"), "ground_truth_chunks", "ground_truth_answer").dropDuplicates(["query_id"])


def _hits(spark, sf_dir, column="content", n=20):
    corpus = _chunks(spark, sf_dir).select(F.col("kb_id").alias("group"), "id", F.col(column).alias("text"))
    return written(retrieval.bm25(corpus, _queries(spark, sf_dir), n), "hits")


def tokenize(spark, sf_dir):
    """Document frequency of every token."""
    own = _chunks(spark, sf_dir).select("id", F.explode(F.array_distinct(retrieval.tokens(F.coalesce("content", F.lit(""))))).alias("token"))
    return own.groupBy("token").agg(F.count("*").alias("df"))


def bm25_topk(spark, sf_dir):
    return retrieval.bm25(_chunks(spark, sf_dir).select(F.col("kb_id").alias("group"), "id", F.col("content").alias("text")), _queries(spark, sf_dir), 20)


def dense_topk(spark, sf_dir):
    """Vectors whose id is divisible by 20 against all rows."""
    found = links.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", None, -1.0, 10, F.col("vec_id") % 20 == 0)
    return found.select("a", "b", F.round("sim", 6).alias("sim"))


def _channels(spark, sf_dir):
    one = _hits(spark, sf_dir).withColumn("channel", F.lit("content"))
    return one.unionByName(_hits(spark, sf_dir, "search_text").withColumn("channel", F.lit("title")))


def rrf_fusion(spark, sf_dir):
    return retrieval.reciprocal_fusion(_channels(spark, sf_dir), ["content", "title"]).select("query_id", "id", "score", F.array_join("sources", "+").alias("sources"))


def snapshot_score(spark, sf_dir):
    return retrieval.snapshot_score(_base(spark, sf_dir)).select("query_id", "id", "score")


def fold_enhanced(spark, sf_dir):
    folded = retrieval.fold_enhanced(_hits(spark, sf_dir, "content", 60).select("query_id", "id", "score"), _chunks(spark, sf_dir))
    return folded.select("query_id", "id", "score", F.array_join("matched_by", "+").alias("matched_by"))


def related_expand(spark, sf_dir):
    return retrieval.expand_related(_hits(spark, sf_dir).select("query_id", "id", "score"), _chunks(spark, sf_dir))


def related_inherit(spark, sf_dir):
    return retrieval.inherit_related(_hits(spark, sf_dir).select("query_id", "id", "score"), _chunks(spark, sf_dir))


def coarse_filter(spark, sf_dir):
    return retrieval.coarse_filter(_hits(spark, sf_dir).select("query_id", "id", "score"), 0.5, 10)


def parent_aggregate(spark, sf_dir):
    found = retrieval.aggregate_parents(_hits(spark, sf_dir).select("query_id", "id", "score"), _chunks(spark, sf_dir))
    return found.select("query_id", "id", F.coalesce("best_child", F.lit("")).alias("best_child"), "score")


def context_window(spark, sf_dir):
    own = _chunks(spark, sf_dir)
    return retrieval.context_windows(retrieval.aggregate_parents(_hits(spark, sf_dir).select("query_id", "id", "score"), own), own)


def _asking_figures(spark, sf_dir):
    """Questions for the first figure or table that each item's text names."""
    text = F.regexp_extract(F.concat_ws(" ", "text", "ground_truth_answer"), f"[图表]\\s*(?:{links.NUMBER})", 0)
    return _queries(spark, sf_dir).select("query_id", "group", text.alias("text"))


def media_reference(spark, sf_dir):
    own = _chunks(spark, sf_dir).withColumnRenamed("kb_id", "group")
    return retrieval.media_reference_hits(_asking_figures(spark, sf_dir), own, 10)


def entity_match(spark, sf_dir):
    own = triples(spark, sf_dir).filter("s IS NOT NULL")
    entities = own.select(F.col("kb_id").alias("group"), F.col("s").alias("name")).distinct().withColumn("aliases", F.array().cast("array<string>"))
    mentions = own.filter("source_chunk IS NOT NULL").select(F.col("kb_id").alias("group"), F.col("s").alias("name"), F.col("source_chunk").alias("chunk_id")).distinct()
    return retrieval.entity_hits(_queries(spark, sf_dir), entities, mentions, 10)


def _seeds(spark, sf_dir):
    asked = _queries(spark, sf_dir).select("query_id", retrieval.intent("text").alias("intent"))
    return _hits(spark, sf_dir, n=5).join(F.broadcast(asked), "query_id").select("query_id", "intent", "id")


def graph_expand(spark, sf_dir):
    return retrieval.expand_graph(_seeds(spark, sf_dir), relations(spark, sf_dir).select("src_id", "dst_id", "rel_type", "weight"))


def _mentioned(spark, sf_dir):
    """(relations with those to entities, mentions): the subjects of the triples of a base are its entities."""
    own = triples(spark, sf_dir).filter("s IS NOT NULL AND source_chunk IS NOT NULL")
    entity = F.concat(F.lit("entity:"), F.coalesce("kb_id", F.lit("")), F.lit(":"), "s")
    named = own.select(F.col("source_chunk").alias("src_id"), entity.alias("dst_id"), F.lit("mentions").alias("rel_type"), F.col("confidence").alias("weight"))
    return relations(spark, sf_dir).select("src_id", "dst_id", "rel_type", "weight").unionByName(named), named.select(F.col("dst_id").alias("entity_id"), F.col("src_id").alias("chunk_id"))


def graph_expand_entities(spark, sf_dir):
    edges, mentions = _mentioned(spark, sf_dir)
    return retrieval.expand_graph(_seeds(spark, sf_dir), edges, mentions=mentions)


def hybrid_retrieve(spark, sf_dir):
    return retrieval.hybrid_retrieve(media_reference(spark, sf_dir), _channels(spark, sf_dir), _chunks(spark, sf_dir), ["content", "title"])


def _base(spark, sf_dir):
    return _channels(spark, sf_dir).groupBy("query_id", "id").agg(
        F.max(F.when(F.col("channel") == "content", F.col("score"))).alias("dense_score"),
        F.max(F.when(F.col("channel") == "title", F.col("score"))).alias("sparse_score"),
        F.max(F.when(F.col("channel") == "content", F.col("rank"))).alias("dense_rank"),
        F.max(F.when(F.col("channel") == "title", F.col("rank"))).alias("sparse_rank"),
    )


def snapshot_roles(spark, sf_dir):
    return retrieval.snapshot_roles(_hits(spark, sf_dir), _chunks(spark, sf_dir))


def snapshot_retrieve(spark, sf_dir):
    return retrieval.snapshot_retrieve(_base(spark, sf_dir), _chunks(spark, sf_dir))


def graph_retrieve(spark, sf_dir):
    found = entity_match(spark, sf_dir)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    entities = found.withColumn("rank", F.row_number().over(order)).withColumn("channel", F.lit("entity"))
    asked = _queries(spark, sf_dir).select("query_id", retrieval.intent("text").alias("intent"))
    edges, mentions = _mentioned(spark, sf_dir)
    candidates = _channels(spark, sf_dir).unionByName(entities.select("query_id", "id", "score", "rank", "channel"))
    found = retrieval.graph_retrieve(candidates, asked, _chunks(spark, sf_dir), edges, ["content", "title", "entity"], mentions)
    return found.withColumn("score", F.round("score", 6))


def final_check(spark, sf_dir):
    """A stand-in model says no to short texts."""
    hits = _hits(spark, sf_dir, n=5).join(_chunks(spark, sf_dir).select("id", "content"), "id")
    answer = F.when(F.length("content") % 11 == 0, F.lit(None).cast("string")).when(F.length("content") < 400, "No.").otherwise("yes")
    return retrieval.final_check(hits.withColumn("answer", answer)).select("query_id", "id", "rank")


def rerank_pipeline(spark, sf_dir):
    """Parents rescored by the length of their text; a stand-in model refuses texts of some lengths."""
    own = _chunks(spark, sf_dir)
    hits = _hits(spark, sf_dir).select("query_id", "id", "score")
    texts = retrieval.aggregate_parents(hits, own).select("query_id", "id").join(own.select("id", F.length("content").alias("n")), "id")
    scores = texts.filter("n IS NOT NULL").select("query_id", "id", F.round(1 / (1 + F.col("n")), 9).alias("rerank_score"))
    answers = texts.select("query_id", "id", F.when(F.col("n") % 3 == 0, "no").otherwise("yes").alias("answer"))
    found = retrieval.rerank_pipeline(hits, own, scores, 5, answers)
    return found.select("query_id", "id", F.coalesce("best_child", F.lit("")).alias("best_child"), "score", "rank", F.md5("context").alias("context"))


def intent_route(spark, sf_dir):
    items = table(spark, sf_dir, "eval_records")
    return items.select(F.col("id").alias("query_id"), retrieval.intent(F.coalesce("query", F.lit(""))).alias("intent"))


def _contexts(spark, sf_dir):
    return _hits(spark, sf_dir, n=5).select(F.col("query_id").alias("answer_id"), F.col("rank").alias("idx"), F.col("id").alias("chunk_id"), F.lit(None).cast("double").alias("rerank_score"), F.col("score").alias("dense_score"))


def _answers(spark, sf_dir):
    number = F.expr("CAST(substring(query_id, 2) AS INT)")
    text = F.concat(F.coalesce("ground_truth_answer", F.lit("")), F.lit("["), (number % 7 + 1).cast("string"), F.lit("][2]["), (number % 3 + 1).cast("string"), F.lit("]"))
    return _queries(spark, sf_dir).select(F.col("query_id").alias("answer_id"), text.alias("answer"))


def citation_parse(spark, sf_dir):
    return retrieval.citations(_answers(spark, sf_dir), _contexts(spark, sf_dir))


def rule_score(spark, sf_dir):
    contexts = _contexts(spark, sf_dir)
    return retrieval.rule_scores(contexts, retrieval.citations(_answers(spark, sf_dir), contexts).select("answer_id", "no", "chunk_id"))


def _texts(spark, sf_dir):
    own = _chunks(spark, sf_dir).select("id", "content", "source", "page")
    return _hits(spark, sf_dir, n=5).join(own, "id").select("query_id", F.col("rank").alias("idx"), "score", "content", "source", "page")


def extractive_answer(spark, sf_dir):
    return retrieval.extracted_answers(_queries(spark, sf_dir).select("query_id", "text"), _texts(spark, sf_dir))


def prompt_build(spark, sf_dir):
    return retrieval.prompts(_queries(spark, sf_dir).select("query_id", "text"), _texts(spark, sf_dir))


def eval_metrics(spark, sf_dir):
    truth = _queries(spark, sf_dir).select("query_id", F.col("ground_truth_chunks").alias("ids"))
    found = _channels(spark, sf_dir).withColumnRenamed("channel", "strategy")
    return evaluate.retrieval_metrics(found, truth, strategies=("content", "title"))


def eval_means(spark, sf_dir):
    return evaluate.mean_metrics(eval_metrics(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize, bm25_topk, dense_topk, rrf_fusion, snapshot_score, fold_enhanced, related_expand, related_inherit, coarse_filter, parent_aggregate, context_window,
        media_reference, entity_match, graph_expand, graph_expand_entities, hybrid_retrieve, snapshot_roles, snapshot_retrieve, graph_retrieve, final_check, rerank_pipeline, intent_route, citation_parse, rule_score, extractive_answer, prompt_build, eval_metrics, eval_means,
    )
}

_TOKEN = "[a-z0-9_]+|[一-鿿]"
_Q = """queries AS (SELECT id AS query_id, kb_id AS grp, coalesce(query, '') AS text, ground_truth_chunks, ground_truth_answer FROM eval_records),
asked AS (SELECT query_id, grp, term, count(*) AS times FROM (SELECT query_id, grp, unnest(regexp_extract_all(lower(text), '%s')) AS term FROM queries) GROUP BY ALL)""" % _TOKEN


def _ranked(name: str, column: str, n: int) -> str:
    return f"""
{name}_lists AS (SELECT kb_id AS grp, id, regexp_extract_all(lower(coalesce({column}, '')), '{_TOKEN}') AS ts FROM {CHUNKS}),
{name}_size AS (SELECT grp, count(*) AS docs, avg(len(ts)) AS mean FROM {name}_lists GROUP BY grp),
{name}_tf AS (SELECT grp, id, len, term, count(*) AS tf FROM (SELECT grp, id, len(ts) AS len, unnest(ts) AS term FROM {name}_lists) WHERE (grp, term) IN (SELECT (grp, term) FROM asked) GROUP BY ALL),
{name}_df AS (SELECT grp, term, count(*) AS df FROM {name}_tf GROUP BY ALL),
{name}_raw AS (SELECT query_id, id, round(sum(times * ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(len, 1) / mean))), 9) AS raw
  FROM {name}_tf JOIN asked USING (grp, term) JOIN {name}_df USING (grp, term) JOIN {name}_size USING (grp) GROUP BY ALL),
{name} AS (SELECT query_id, id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM {name}_raw) WHERE rank <= {n} AND raw > 0)"""


_HITS = "WITH " + _Q + "," + _ranked("hits", "content", 20)
_FIVE = "WITH " + _Q + "," + _ranked("hits", "content", 5)
_TWO = _HITS + "," + _ranked("titles", "search_text", 20)
_LISTED = f"""(SELECT id, unnest(l) AS rel, unnest(range(len(l))) AS pos FROM (
  SELECT id, CAST(json(CASE WHEN json_valid(related_ids) AND json_type(related_ids) = 'ARRAY' THEN related_ids END) AS VARCHAR[]) AS l0,
    list_transform(list_filter(list_zip(l0, range(len(l0))), lambda z: list_position(l0, z[1]) = z[2] + 1), lambda z: z[1]) AS l FROM {CHUNKS}))"""
_PARENTS = f"""parents AS (SELECT query_id, parent AS id, arg_min(child, (-score, cid)) AS best_child, max(score) AS score FROM (
  SELECT query_id, h.id AS cid, CASE WHEN layer = 'child' AND parent_id IS NOT NULL THEN parent_id ELSE h.id END AS parent,
    CASE WHEN layer = 'child' AND parent_id IS NOT NULL THEN h.id ELSE '' END AS child, score FROM hits h JOIN {CHUNKS} c ON c.id = h.id) GROUP BY ALL)"""
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{p}') THEN '{i}'" for i, p in retrieval.INTENTS) + " ELSE 'general' END"
_PRIORITY = "CASE " + " ".join(f"WHEN intent = '{i}' AND rel_type = '{t}' THEN {p}" for i, own in retrieval.PRIORITIES.items() for t, p in own.items()) + " ELSE 0.5 END"
_CONTEXTS = "contexts AS (SELECT query_id AS answer_id, rank AS idx, id AS chunk_id, score FROM hits)"
_ANSWERS = """answers AS (SELECT query_id AS answer_id, coalesce(ground_truth_answer, '') || '[' || (CAST(substring(query_id, 2) AS INT) % 7 + 1) || '][2][' || (CAST(substring(query_id, 2) AS INT) % 3 + 1) || ']' AS answer FROM queries),
used AS (SELECT answer_id, CAST(n AS INT) AS no, min(pos) AS pos FROM (SELECT answer_id, unnest(l) AS n, unnest(range(len(l))) AS pos FROM (
  SELECT answer_id, regexp_extract_all(answer, '\\[(\\d{1,9})\\]', 1) AS l FROM answers)) GROUP BY ALL),
cited AS (SELECT u.answer_id, no, chunk_id, row_number() OVER (PARTITION BY u.answer_id ORDER BY pos)::INT AS first FROM used u JOIN contexts c ON c.answer_id = u.answer_id AND c.idx = u.no)"""
_METRICS = """
, every AS (SELECT 'content' AS strategy, * FROM hits UNION ALL SELECT 'title', * FROM titles),
truth AS (SELECT query_id, list_distinct(coalesce(ground_truth_chunks, [])) AS ids FROM queries),
metrics AS (SELECT strategy, query_id, round(count(*) FILTER (WHERE hit AND rank <= 5) / greatest(any_value(len(ids)), 1), 6) AS recall,
    round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE hit), 0), 6) AS mrr,
    round(coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE hit AND rank <= 5), 0) / any_value(list_sum(list_transform(range(1, greatest(least(len(ids), 5), 1) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg
  FROM (SELECT strategy, query_id, ids, rank, coalesce(list_contains(ids, e.id), false) AS hit FROM (SELECT * FROM truth CROSS JOIN (VALUES ('content'), ('title')) n(strategy)) LEFT JOIN every e USING (strategy, query_id)) GROUP BY ALL)
"""
_MARK = " OR ".join(f"starts_with(content, '{m}')" for m in retrieval.MEDIA_MARKERS)
_NUM = links.NUMBER
_DIGITS = "regexp_replace(translate({0}, '０１２３４５６７８９', '0123456789'), '[\\s\\-－–—]', '', 'g')"

_MEDIA = f"""named AS (SELECT query_id, grp, regexp_extract(concat_ws(' ', text, ground_truth_answer), '[图表]\\s*(?:{_NUM})') AS x FROM queries),
keys AS (SELECT query_id, grp, left(x, 1) || {_DIGITS.format('substring(x, 2)')} AS key FROM named WHERE x <> ''),
found AS (SELECT query_id, id, CASE WHEN contains({_DIGITS.format("coalesce(title, '')")}, key) THEN 0 ELSE 1 END AS late, coalesce(page, 0) AS page, chunk_index FROM {CHUNKS} c JOIN keys k ON k.grp = c.kb_id
  WHERE contains({_DIGITS.format("coalesce(title, '')")}, key) OR contains({_DIGITS.format("coalesce(content, '')")}, key)),
media AS (SELECT query_id, id, round(greatest(1 - 0.02::DOUBLE * (rank - 1), 0.7::DOUBLE), 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, page, chunk_index NULLS FIRST, id) AS rank FROM found) WHERE rank <= 10)"""
_IDS = "(SELECT id FROM tmp_chunks_upload)"


def _fused(*channels: tuple[str, str]) -> str:
    every = " UNION ALL ".join(f"SELECT query_id, id, score, rank, {k} AS o FROM {name}" for k, (name, _) in enumerate(channels))
    return f"fused AS (SELECT query_id, id, round(arg_min(score, o) + sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM ({every}) GROUP BY query_id, id)"


def _folded(source: str) -> str:
    return f"""folded AS (SELECT query_id, t.id, round(max(score), 6) AS score FROM (SELECT query_id, CASE WHEN layer = 'enhanced' THEN parent_id ELSE c.id END AS id,
  score * CASE WHEN layer = 'enhanced' AND ({_MARK}) THEN 0.95::DOUBLE WHEN layer = 'enhanced' THEN 0.85::DOUBLE ELSE 1 END AS score FROM {source} h JOIN {CHUNKS} c ON c.id = h.id) t WHERE t.id IN {_IDS} GROUP BY ALL)"""


def _with_related(name: str, source: str) -> str:
    return f"""{name} AS (SELECT query_id, id, score FROM {source} UNION ALL SELECT DISTINCT query_id, rel, 0.3::DOUBLE FROM {source} h JOIN {_LISTED} l ON l.id = h.id
  WHERE rel IN {_IDS} AND (query_id, rel) NOT IN (SELECT (query_id, id) FROM {source}))"""


def _inherited(source: str) -> str:
    return f"""told AS (SELECT query_id, rel AS id, -score AS s, l.id AS from_id, pos FROM {source} h JOIN {_LISTED} l ON l.id = h.id WHERE rel IS NOT NULL AND (query_id, rel) NOT IN (SELECT (query_id, id) FROM {source})),
told1 AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY s, from_id, pos) = 1),
inherited AS (SELECT query_id, id, score FROM (SELECT query_id, f.id, coalesce(is_image_chunk, false) AS image, round(greatest(0.24::DOUBLE, -s * CASE WHEN coalesce(is_image_chunk, false) THEN 0.45::DOUBLE ELSE 0.85::DOUBLE END), 8) AS score,
  row_number() OVER (PARTITION BY query_id, coalesce(is_image_chunk, false), coalesce(document_id, ''), coalesce(page, -1) ORDER BY s, from_id, pos, f.id) AS n FROM told1 f JOIN {CHUNKS} c ON c.id = f.id) WHERE NOT image OR n = 1)"""


_EDGES = f"""edges AS (SELECT src_id, dst_id, rel_type, coalesce(weight::DOUBLE, 0) AS weight FROM {RELATIONS} WHERE dst_id IS NOT NULL AND rel_type <> 'mentions'),
told_of AS (SELECT 'entity:' || coalesce(kb_id, '') || ':' || s AS entity, source_chunk AS chunk, coalesce(confidence::DOUBLE, 0) AS weight FROM {TRIPLES} WHERE s IS NOT NULL AND source_chunk IS NOT NULL),
told_in AS (SELECT DISTINCT entity, chunk FROM told_of)"""


def _hop(name: str, before: str, decay: str, seen: list[str]) -> str:
    gone = " AND ".join(f"(query_id, id) NOT IN (SELECT (query_id, id) FROM {t})" for t in seen)
    named = _PRIORITY.replace("rel_type", "'mentions'")
    return f"""{name} AS (SELECT query_id, intent, id, max(score) AS score FROM (
  SELECT query_id, intent, dst_id AS id, score * weight * {decay} * {_PRIORITY} AS score FROM {before} b JOIN edges e ON e.src_id = b.id
  UNION ALL SELECT query_id, intent, i.chunk, top * 0.9 FROM (SELECT query_id, intent, entity, max(score * weight * {decay} * {named}) AS top FROM {before} b JOIN told_of t ON t.chunk = b.id GROUP BY ALL) JOIN told_in i USING (entity))
  WHERE {gone} GROUP BY ALL)"""


def _expanded(seeds: str) -> str:
    return f"""{_EDGES}, start AS (SELECT query_id, intent, id, 1.0::DOUBLE AS score FROM {seeds}), {_hop('level1', 'start', '1', ['start'])}, {_hop('level2', 'level1', '0.6', ['start', 'level1'])},
expanded AS (SELECT query_id, id, round(score, 9) AS score, hop FROM (SELECT *, 1 AS hop FROM level1 UNION ALL SELECT *, 2 FROM level2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, round(score, 9) DESC, id) <= 50)"""


SQL = {
    "tokenize": f"SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(content, '')), '{_TOKEN}')) AS token FROM {CHUNKS}) GROUP BY token",
    "bm25_topk": _HITS + " SELECT * FROM hits",
    "dense_topk": """
SELECT a, b, round(sim, 6) AS sim FROM (
  SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS sim FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0)
QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 10""",
    "rrf_fusion": _TWO
    + """ SELECT query_id, id, round(arg_min(score, o) + sum(1.0::DOUBLE / (60 + rank)), 6) AS score, string_agg(channel, '+' ORDER BY channel) AS sources FROM (
  SELECT *, 1 AS o, 'content' AS channel FROM hits UNION ALL SELECT *, 2, 'title' FROM titles) GROUP BY query_id, id""",
    "snapshot_score": _TWO
    + """ SELECT query_id, id, round(CASE WHEN rel > 0 THEN least(rel + rrf, 1) ELSE rrf END, 6) AS score FROM (
  SELECT coalesce(h.query_id, t.query_id) AS query_id, coalesce(h.id, t.id) AS id, greatest(coalesce(h.score, 0), least(greatest(coalesce(t.score, 0), 0), 1)) AS rel,
    coalesce(1.0::DOUBLE / (60 + h.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0) AS rrf FROM hits h FULL JOIN titles t ON h.query_id = t.query_id AND h.id = t.id)""",
    "fold_enhanced": "WITH " + _Q + "," + _ranked("hits", "content", 60)
    + f""" SELECT query_id, t.id, round(max(score), 6) AS score, string_agg(DISTINCT layer, '+' ORDER BY layer) AS matched_by FROM (
  SELECT query_id, CASE WHEN layer = 'enhanced' THEN parent_id ELSE c.id END AS id, coalesce(layer, 'child') AS layer,
    score * CASE WHEN layer = 'enhanced' AND ({_MARK}) THEN 0.95::DOUBLE WHEN layer = 'enhanced' THEN 0.85::DOUBLE ELSE 1 END AS score FROM hits h JOIN {CHUNKS} c ON c.id = h.id) t
WHERE t.id IN (SELECT id FROM tmp_chunks_upload) GROUP BY ALL""",
    "related_expand": _HITS
    + f""", new AS (SELECT DISTINCT query_id, rel AS id FROM hits h JOIN {_LISTED} l ON l.id = h.id WHERE rel IN (SELECT id FROM tmp_chunks_upload))
SELECT query_id, id, score, 'hit' AS channel FROM hits UNION ALL SELECT query_id, id, 0.3::DOUBLE, 'related' FROM new WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM hits)""",
    "related_inherit": _HITS
    + f""", named AS (SELECT query_id, rel AS id, -score AS s, l.id AS from_id, pos FROM hits h JOIN {_LISTED} l ON l.id = h.id WHERE rel IS NOT NULL AND (query_id, rel) NOT IN (SELECT (query_id, id) FROM hits)),
first AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY s, from_id, pos) = 1)
SELECT query_id, id, score FROM (SELECT query_id, f.id, coalesce(is_image_chunk, false) AS image, round(greatest(0.24::DOUBLE, -s * CASE WHEN coalesce(is_image_chunk, false) THEN 0.45::DOUBLE ELSE 0.85::DOUBLE END), 8) AS score,
  row_number() OVER (PARTITION BY query_id, coalesce(is_image_chunk, false), coalesce(document_id, ''), coalesce(page, -1) ORDER BY s, from_id, pos, f.id) AS n FROM first f JOIN {CHUNKS} c ON c.id = f.id) WHERE NOT image OR n = 1""",
    "coarse_filter": _HITS + " SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM hits WHERE score >= 0.5 QUALIFY rank <= 10",
    "parent_aggregate": _HITS + "," + _PARENTS + " SELECT query_id, id, best_child, score FROM parents",
    "context_window": _HITS + "," + _PARENTS
    + f""", numbered AS (SELECT id, parent_id, coalesce(content, '') AS content, row_number() OVER (PARTITION BY parent_id ORDER BY chunk_index, id) AS n, count(*) OVER (PARTITION BY parent_id) AS total
  FROM {CHUNKS} WHERE layer = 'child' AND parent_id IS NOT NULL),
centre AS (SELECT query_id, p.id, greatest(least(n - 1, total - 2), 1) AS lo FROM parents p JOIN numbered m ON m.id = p.best_child AND m.parent_id = p.id)
SELECT query_id, c.id, string_agg(content, chr(10) || chr(10) ORDER BY n) AS context FROM centre c JOIN numbered m ON m.parent_id = c.id AND m.n >= lo AND m.n < lo + 3 GROUP BY ALL""",
    "media_reference": "WITH " + _Q
    + f""", named AS (SELECT query_id, grp, regexp_extract(concat_ws(' ', text, ground_truth_answer), '[图表]\\s*(?:{_NUM})') AS x FROM queries),
keys AS (SELECT query_id, grp, left(x, 1) || {_DIGITS.format('substring(x, 2)')} AS key FROM named WHERE x <> ''),
found AS (SELECT query_id, id, CASE WHEN contains({_DIGITS.format("coalesce(title, '')")}, key) THEN 0 ELSE 1 END AS late, coalesce(page, 0) AS page, chunk_index FROM {CHUNKS} c JOIN keys k ON k.grp = c.kb_id
  WHERE contains({_DIGITS.format("coalesce(title, '')")}, key) OR contains({_DIGITS.format("coalesce(content, '')")}, key))
SELECT query_id, id, round(greatest(1 - 0.02::DOUBLE * (rank - 1), 0.7::DOUBLE), 6) AS score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, page, chunk_index NULLS FIRST, id) AS rank FROM found) WHERE rank <= 10""",
    "entity_match": "WITH " + _Q
    + f""", entities AS (SELECT DISTINCT kb_id AS grp, s AS name FROM {TRIPLES} WHERE s IS NOT NULL),
scored AS (SELECT query_id, e.grp, name, round(CASE WHEN lower(trim(name)) = '' THEN 0 WHEN lower(trim(text)) = lower(trim(name)) THEN 1 WHEN contains(lower(trim(text)), lower(trim(name))) OR contains(lower(trim(name)), lower(trim(text))) THEN 0.92
    ELSE coalesce(0.4 + 0.4 * nullif(len(list_intersect(regexp_extract_all(lower(text), '{_TOKEN}'), regexp_extract_all(lower(name), '{_TOKEN}'))), 0)::DOUBLE / len(list_distinct(regexp_extract_all(lower(name), '{_TOKEN}'))), 0) END::DOUBLE, 6) AS score
  FROM entities e JOIN queries q USING (grp)),
top AS (SELECT * FROM scored WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) <= 10)
SELECT query_id, id, score FROM (SELECT query_id, source_chunk AS id, max(score) AS score FROM top t JOIN {TRIPLES} m ON m.kb_id = t.grp AND m.s = t.name WHERE source_chunk IS NOT NULL GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""",
    "graph_expand": _FIVE
    + f""", seeds AS (SELECT h.query_id, {_INTENT.format('text')} AS intent, id FROM hits h JOIN queries q USING (query_id)),
edges AS (SELECT src_id, dst_id, rel_type, coalesce(weight::DOUBLE, 0) AS weight FROM {RELATIONS} WHERE dst_id IS NOT NULL),
one AS (SELECT query_id, intent, dst_id AS id, max(weight * {_PRIORITY}) AS score FROM seeds s JOIN edges e ON e.src_id = s.id GROUP BY ALL),
level1 AS (SELECT * FROM one WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM seeds)),
two AS (SELECT query_id, intent, dst_id AS id, max(score * weight * 0.6 * {_PRIORITY}) AS score FROM level1 l JOIN edges e ON e.src_id = l.id GROUP BY ALL),
level2 AS (SELECT * FROM two WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM seeds) AND (query_id, id) NOT IN (SELECT (query_id, id) FROM level1))
SELECT query_id, id, score, hop FROM (SELECT query_id, id, round(score, 9) AS score, 1 AS hop FROM level1 UNION ALL SELECT query_id, id, round(score, 9), 2 FROM level2)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, score DESC, id) <= 50""",
    "graph_expand_entities": _FIVE + f", seeds AS (SELECT h.query_id, {_INTENT.format('text')} AS intent, id FROM hits h JOIN queries q USING (query_id)), " + _expanded("seeds") + " SELECT * FROM expanded",
    "hybrid_retrieve": _TWO + "," + _MEDIA + "," + _fused(("hits", ""), ("titles", "")) + "," + _folded("fused")
    + """, kept AS (SELECT query_id, id, score FROM media UNION ALL SELECT query_id, id, score FROM folded WHERE query_id NOT IN (SELECT query_id FROM media)), """
    + _with_related("more", "kept")
    + """ SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, CASE WHEN query_id IN (SELECT query_id FROM media) THEN 'media' ELSE 'fusion' END AS route
FROM more WHERE score >= 0.3 QUALIFY rank <= 20""",
    "snapshot_roles": _HITS
    + f""", folds AS (SELECT DISTINCT query_id, parent_id AS id FROM hits h JOIN {CHUNKS} c ON c.id = h.id WHERE layer = 'enhanced' AND parent_id IS NOT NULL),
both_of AS (SELECT query_id, id FROM hits UNION SELECT query_id, id FROM folds),
rel AS (SELECT query_id, rel AS id FROM (SELECT DISTINCT query_id, rel FROM both_of b JOIN {_LISTED} l ON l.id = b.id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rel) <= 200)
SELECT * FROM (SELECT query_id, id, 'base' AS role FROM hits UNION SELECT query_id, id, 'fold' FROM folds UNION SELECT query_id, id, 'related' FROM rel) WHERE id IN {_IDS}""",
    "snapshot_retrieve": _TWO
    + """, scored AS (SELECT query_id, id, round(CASE WHEN rel > 0 THEN least(rel + rrf, 1) ELSE rrf END, 6) AS score FROM (
  SELECT coalesce(h.query_id, t.query_id) AS query_id, coalesce(h.id, t.id) AS id, greatest(coalesce(h.score, 0), least(greatest(coalesce(t.score, 0), 0), 1)) AS rel,
    coalesce(1.0::DOUBLE / (60 + h.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0) AS rrf FROM hits h FULL JOIN titles t ON h.query_id = t.query_id AND h.id = t.id)), """
    + _folded("scored") + "," + _inherited("folded")
    + """ SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM (SELECT * FROM folded UNION ALL SELECT * FROM inherited) WHERE score >= 0.3 QUALIFY rank <= 20""",
    "graph_retrieve": _TWO
    + f""", entities AS (SELECT DISTINCT kb_id AS grp, s AS name FROM {TRIPLES} WHERE s IS NOT NULL),
matched AS (SELECT query_id, e.grp, name, round(CASE WHEN lower(trim(name)) = '' THEN 0 WHEN lower(trim(text)) = lower(trim(name)) THEN 1 WHEN contains(lower(trim(text)), lower(trim(name))) OR contains(lower(trim(name)), lower(trim(text))) THEN 0.92
    ELSE coalesce(0.4 + 0.4 * nullif(len(list_intersect(regexp_extract_all(lower(text), '{_TOKEN}'), regexp_extract_all(lower(name), '{_TOKEN}'))), 0)::DOUBLE / len(list_distinct(regexp_extract_all(lower(name), '{_TOKEN}'))), 0) END::DOUBLE, 6) AS score
  FROM entities e JOIN queries q USING (grp)),
ents AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, source_chunk AS id, max(score) AS score FROM (
    SELECT * FROM matched WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) <= 10) t
  JOIN {TRIPLES} m ON m.kb_id = t.grp AND m.s = t.name WHERE source_chunk IS NOT NULL GROUP BY ALL) QUALIFY rank <= 10), """
    + _fused(("hits", ""), ("titles", ""), ("ents", "")) + "," + _with_related("more", "fused")
    + f""", tops AS (SELECT * FROM more WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10),
seeds AS (SELECT t.query_id, {_INTENT.format('text')} AS intent, id FROM tops t JOIN queries q USING (query_id)), """
    + _expanded("seeds")
    + """ SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, channel FROM (
  SELECT query_id, id, max(score) AS score, min(channel) AS channel FROM (SELECT query_id, id, score, 'seed' AS channel FROM tops UNION ALL SELECT query_id, id, score, 'graph_expand' FROM expanded) GROUP BY ALL) QUALIFY rank <= 5""",
    "final_check": _FIVE
    + f""", told AS (SELECT query_id, h.id, rank, CASE WHEN length(content) % 11 = 0 THEN NULL WHEN length(content) < 400 THEN false ELSE true END AS yes FROM hits h JOIN {CHUNKS} c ON c.id = h.id)
SELECT query_id, id, rank FROM told WHERE yes OR query_id IN (SELECT query_id FROM told GROUP BY query_id HAVING count(*) > count(yes) OR NOT bool_or(yes))""",
    "rerank_pipeline": _HITS + "," + _PARENTS
    + f""", ranked AS (SELECT query_id, p.id, best_child, coalesce(round(1 / (1 + length(content))::DOUBLE, 9), score) AS score, coalesce(length(content) % 3 = 0, false) AS refused, content
  FROM parents p LEFT JOIN {CHUNKS} c ON c.id = p.id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM ranked QUALIFY rank <= 5),
kept AS (SELECT * FROM best b WHERE NOT refused OR query_id IN (SELECT query_id FROM best b LEFT JOIN (SELECT id AS known FROM {CHUNKS}) k ON k.known = b.id GROUP BY query_id HAVING bool_and(refused) OR count(*) > count(known))),
numbered AS (SELECT id, parent_id, coalesce(content, '') AS content, row_number() OVER (PARTITION BY parent_id ORDER BY chunk_index, id) AS n, count(*) OVER (PARTITION BY parent_id) AS total
  FROM {CHUNKS} WHERE layer = 'child' AND parent_id IS NOT NULL),
centre AS (SELECT query_id, p.id, greatest(least(n - 1, total - 2), 1) AS lo FROM kept p JOIN numbered m ON m.id = p.best_child AND m.parent_id = p.id),
around AS (SELECT query_id, c.id, string_agg(content, chr(10) || chr(10) ORDER BY n) AS context FROM centre c JOIN numbered m ON m.parent_id = c.id AND m.n >= lo AND m.n < lo + 3 GROUP BY ALL)
SELECT query_id, k.id, coalesce(best_child, '') AS best_child, score, rank, md5(coalesce(a.context, k.content, '')) AS context FROM kept k LEFT JOIN around a USING (query_id, id)""",
    "intent_route": f"SELECT id AS query_id, {_INTENT.format(chr(99) + 'oalesce(query, ' + chr(39) * 2 + ')')} AS intent FROM eval_records",
    "citation_parse": _FIVE + "," + _CONTEXTS + "," + _ANSWERS + " SELECT answer_id, no, chunk_id, first FROM cited",
    "rule_score": _FIVE + "," + _CONTEXTS + "," + _ANSWERS
    + """ SELECT answer_id, relevance, CASE WHEN answer_id IN (SELECT answer_id FROM cited) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS valid_citations FROM (
  SELECT answer_id, round(avg(score), 4) AS relevance FROM contexts GROUP BY answer_id)""",
    "eval_metrics": _TWO + _METRICS + "SELECT * FROM metrics",
    "eval_means": _TWO + _METRICS + "SELECT strategy, count(*) AS queries, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM metrics GROUP BY strategy",
    "extractive_answer": _FIVE
    + f""", strong AS (SELECT h.query_id, rank AS idx, coalesce(content, '') AS content FROM hits h JOIN {CHUNKS} c ON c.id = h.id WHERE score >= 0.65 QUALIFY row_number() OVER (PARTITION BY h.query_id ORDER BY rank) <= 4),
parts AS (SELECT query_id, idx, list_filter(list_transform(regexp_extract_all(content, '[^。！？；;]*[。！？；;]|[^。！？；;]+$'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS l FROM strong),
told AS (SELECT query_id, list_distinct(regexp_extract_all(text, '[一-鿿]{{2,}}|[A-Za-z0-9_]+')) AS terms FROM queries),
scored AS (SELECT p.query_id, idx, sentence, pl, len(list_filter(terms, lambda t: contains(sentence, t))) AS h FROM (SELECT query_id, idx, unnest(l) AS sentence, unnest(range(len(l))) AS pl FROM parts) p JOIN told USING (query_id)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, idx ORDER BY h DESC, length(sentence) DESC, pl) = 1)
SELECT query_id, idx, left(sentence, 220) AS sentence FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY idx) <= 3""",
    "prompt_build": _FIVE
    + f""" SELECT h.query_id, string_agg('[' || rank || '] ' || coalesce(source, '') || ' P.' || (coalesce(page, 0) + 1) || chr(10) || left(coalesce(content, ''), 500), chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || any_value(q.text) AS prompt
FROM hits h JOIN {CHUNKS} c ON c.id = h.id JOIN queries q USING (query_id) GROUP BY h.query_id""",
}
