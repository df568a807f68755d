"""Retrieval: sparse and dense ranking, fusion, folding, expansion, context and answers.

Candidates have ``query_id, id, score`` and whatever else an operator names. Rankings break ties by id, so
every result is determined. Ranks are windows per query and only the best rows pass, so partial
limits run before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.text import cosine, first_match, media_number, strip, tokens
from chunkweave.operators.enrich import rerank
from chunkweave.operators.links import NUMBER
from chunkweave.runtime import broadcast_if_small, written

# What a question asks for, in order; weights of relations for each kind of question.
INTENTS = [
    ("procedure", "如何|怎么|步骤|流程|方法|操作"),
    ("concept", "什么是|定义|含义|概念|介绍"),
    ("data", "多少|数据|比例|数值|年份"),
    ("visual", "图|示意图|图示|展示"),
]
PRIORITIES = {
    "concept": {"mentions": 1.0, "sibling": 0.8, "semantic_similar": 0.7},
    "procedure": {"next_step": 1.0, "prev_step": 0.9, "sibling": 0.6},
    "data": {"refers_to": 0.9, "sibling": 0.7},
    "visual": {"refers_to": 1.0, "adjacent": 0.7},
    "general": {"adjacent": 0.6, "sibling": 0.6, "semantic_similar": 0.6},
}
#: Openings of enhanced texts of images and tables.
MEDIA_MARKERS = ("[图片描述]", "[图像描述]", "[表格描述]")


def _best(df: DataFrame, n: int, *order: Column | str, by: str = "query_id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= n)


def intent(query: Column | str) -> Column:
    return first_match(query, INTENTS, "general")


def bm25(corpus: DataFrame, queries: DataFrame, n: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_id, id, score, rank``: sparse ranking inside the group that a query names.

    ``corpus``: ``group, id, text``; ``queries``: ``query_id, group, text``. A repeated query token counts
    repeatedly; scores are divided by the best of the query; only positive ones stay. Postings are cut to the
    query terms by a broadcast of those terms before anything is shuffled.
    """
    asked = queries.select("query_id", "group", F.explode(tokens("text")).alias("term")).groupBy("query_id", "group", "term").agg(F.count("*").alias("times"))
    terms = broadcast_if_small(asked.select("term", "group").distinct())
    lists = corpus.select("group", "id", tokens(F.coalesce("text", F.lit(""))).alias("ts")).withColumn("len", F.size("ts"))
    size = lists.groupBy("group").agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    postings = lists.select("group", "id", "len", F.explode("ts").alias("term")).join(terms, ["group", "term"], "left_semi")
    tf = postings.groupBy("group", "term", "id", "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("group", "term").agg(F.count("*").alias("df"))
    weights = asked.join(df, ["group", "term"]).join(broadcast_if_small(size), "group")
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = weights.select("query_id", "group", "term", (idf * F.col("times")).alias("w"), "mean")
    norm = F.col("tf") + k1 * (1 - b + b * F.greatest("len", F.lit(1)) / F.col("mean"))
    summed = (
        tf.join(broadcast_if_small(weights), ["group", "term"])
        .groupBy("query_id", "id")
        .agg(F.sum(F.col("w") * F.col("tf") * (k1 + 1) / norm).alias("raw"))
    )
    top = _best(summed.withColumn("raw", F.round("raw", 9)), n, F.desc("raw"), "id")
    most = F.max("raw").over(Window.partitionBy("query_id"))
    return top.withColumn("score", F.round(F.col("raw") / most, 6)).filter("raw > 0").select("query_id", "id", "score", "rank")


def reciprocal_fusion(candidates: DataFrame, order: list[str], k: int = 60, pure: bool = False) -> DataFrame:
    """``query_id, id, score, sources``: the score in the first channel of ``order`` plus ``1 / (k + rank)`` of each."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("channel"))
    fused = candidates.groupBy("query_id", "id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.min_by("score", place).alias("base"), F.array_sort(F.collect_set("channel")).alias("sources")
    )
    score = F.col("rrf") if pure else F.col("base") + F.col("rrf")
    return fused.select("query_id", "id", F.round(score, 6).alias("score"), "sources")


def snapshot_score(candidates: DataFrame, k: int = 60) -> DataFrame:
    """Score of ``dense_score, sparse_score, dense_rank, sparse_rank`` (each may be null): relevance plus fusion, at most 1."""
    rrf = sum((F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0)) for c in ("dense_rank", "sparse_rank")), F.lit(0.0))
    sparse = F.least(F.greatest(F.coalesce("sparse_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    relevance = F.greatest(F.coalesce("dense_score", F.lit(0.0)), sparse)
    return candidates.withColumn("score", F.round(F.when(relevance > 0, F.least(relevance + rrf, F.lit(1.0))).otherwise(rrf), 6))


def fold_enhanced(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Enhanced hits folded into the chunk they belong to: ``query_id, id, score, matched_by``.

    ``chunks``: ``id, layer, parent_id, content``. An enhanced score counts .95 for images and tables, else .85; the
    best score wins; an enhanced hit whose chunk is unknown is dropped.
    """
    own = chunks.select("id", "layer", "parent_id", F.coalesce("content", F.lit("")).alias("content"))
    joined = candidates.join(own, "id")
    media = reduce(lambda a, b: a | b, [F.col("content").startswith(m) for m in MEDIA_MARKERS])
    enhanced = F.col("layer") == "enhanced"
    factor = F.when(enhanced & media, 0.95).when(enhanced, 0.85).otherwise(1.0)
    target = F.when(enhanced, F.col("parent_id")).otherwise(F.col("id"))
    moved = joined.select("query_id", target.alias("id"), (F.col("score") * factor).alias("score"), F.coalesce("layer", F.lit("child")).alias("layer"))
    known = moved.join(own.select("id"), "id", "left_semi")
    return known.groupBy("query_id", "id").agg(F.round(F.max("score"), 6).alias("score"), F.array_sort(F.collect_set("layer")).alias("matched_by"))


def _related(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    listed = chunks.select("id", F.array_distinct(F.from_json("related_ids", "array<string>")).alias("related"))
    return candidates.join(listed, "id").select("query_id", F.col("id").alias("from_id"), "score", F.posexplode("related").alias("rel_pos", "id"))


def expand_related(candidates: DataFrame, chunks: DataFrame, score: float = 0.3) -> DataFrame:
    """Candidates and their related chunks, these at a fixed score: ``query_id, id, score, channel``."""
    new = _related(candidates, chunks).select("query_id", "id").distinct().join(candidates, ["query_id", "id"], "left_anti")
    known = new.join(chunks.select("id"), "id", "left_semi")
    return candidates.select("query_id", "id", "score", F.lit("hit").alias("channel")).unionByName(
        known.select("query_id", "id", F.lit(score).alias("score"), F.lit("related").alias("channel"))
    )


def inherit_related(candidates: DataFrame, chunks: DataFrame, least: float = 0.24) -> DataFrame:
    """Related chunks that inherit .85 of the first candidate that names them (.45 for images), one image per page."""
    named = _related(candidates, chunks).join(candidates.select("query_id", "id"), ["query_id", "id"], "left_anti")
    order = F.struct(-F.col("score"), F.col("from_id"), F.col("rel_pos"))
    first = named.groupBy("query_id", "id").agg(F.min(order).alias("o"))
    info = chunks.select("id", F.coalesce("document_id", F.lit("")).alias("doc"), F.coalesce("page", F.lit(-1)).alias("page"), F.coalesce("is_image_chunk", F.lit(False)).alias("image"))
    joined = first.join(info, "id")
    factor = F.when(F.col("image"), 0.45).otherwise(0.85)
    scored = joined.withColumn("score", F.round(F.greatest(F.lit(least), -F.col("o.col1") * factor), 8))
    page = Window.partitionBy("query_id", "image", "doc", "page").orderBy("o", "id")
    return scored.withColumn("n", F.row_number().over(page)).filter(~F.col("image") | (F.col("n") == 1)).select("query_id", "id", "score")


def coarse_filter(candidates: DataFrame, least: float, n: int) -> DataFrame:
    return _best(candidates.filter(F.col("score") >= least), n, F.desc("score"), "id").select("query_id", "id", "score", "rank")


def aggregate_parents(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """The best child stands for its parent; other candidates pass: ``query_id, id, best_child, score``."""
    own = chunks.select("id", "layer", "parent_id")
    joined = candidates.join(own, "id")
    child = (F.col("layer") == "child") & F.col("parent_id").isNotNull()
    moved = joined.select("query_id", F.when(child, F.col("parent_id")).otherwise(F.col("id")).alias("parent"), F.when(child, F.col("id")).alias("child"), "score", "id")
    best = moved.groupBy("query_id", "parent").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "child")).alias("b"))
    return best.select("query_id", F.col("parent").alias("id"), F.col("b.child").alias("best_child"), (-F.col("b.s")).alias("score"))


def context_windows(parents: DataFrame, chunks: DataFrame, size: int = 3) -> DataFrame:
    """``query_id, id, context``: the children around the best one, ``size`` of them, shifted inside at the edges."""
    order = Window.partitionBy("parent_id").orderBy("chunk_index", "id")
    children = chunks.filter("layer = 'child' AND parent_id IS NOT NULL")
    numbered = children.select("id", "parent_id", F.coalesce("content", F.lit("")).alias("content"), F.row_number().over(order).alias("n"), F.count("*").over(Window.partitionBy("parent_id")).alias("of"))
    wanted = parents.filter("best_child IS NOT NULL").select("query_id", F.col("id").alias("parent_id"), "best_child")
    centre = wanted.join(numbered.select(F.col("id").alias("best_child"), F.col("n").alias("c"), "of"), "best_child")
    begin = F.greatest(F.least(F.col("c") - size // 2, F.col("of") - size + 1), F.lit(1))
    centre = centre.select("query_id", "parent_id", begin.alias("begin"))
    inside = centre.join(numbered.drop("of"), "parent_id").filter((F.col("n") >= F.col("begin")) & (F.col("n") < F.col("begin") + size))
    ordered = F.array_sort(F.collect_list(F.struct("n", "content")))
    return inside.groupBy("query_id", "parent_id").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n\n").alias("context")).withColumnRenamed("parent_id", "id")


def media_reference_hits(queries: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Chunks that bear the figure or table a query names; hits in the title first: ``query_id, id, score, rank``.

    ``queries``: ``query_id, group, text``; ``chunks``: ``group, id, title, content, page, chunk_index``.
    """
    named = F.regexp_extract("text", f"([图表])\\s*({NUMBER})", 0)
    asked = queries.withColumn("named", named).filter("named != ''").select("query_id", "group", F.concat(F.left("named", F.lit(1)), media_number(F.expr("substring(named, 2)"))).alias("key"))
    flat = lambda c: media_number(F.coalesce(F.col(c), F.lit("")))
    texts = chunks.select("group", "id", flat("title").alias("t"), flat("content").alias("c"), F.coalesce("page", F.lit(0)).alias("page"), "chunk_index")
    joined = texts.join(broadcast_if_small(asked), "group")
    hits = joined.filter(F.contains("t", "key") | F.contains("c", "key")).withColumn("late", F.when(F.contains("t", "key"), 0).otherwise(1))
    top = _best(hits, n, "late", "page", "chunk_index", "id")
    return top.select("query_id", "id", F.round(F.greatest(1 - 0.02 * (F.col("rank") - 1), F.lit(0.7)), 6).alias("score"), "rank")


def entity_score(query: Column, name: Column, aliases: Column, similarity: Column | None = None) -> Column:
    """1 for equal names, .92 for containment, .4 to .8 by shared tokens, .85 of the similarity; the best of all."""
    asked = F.lower(strip(query))
    names = F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    own = tokens(asked)

    def one(raw: Column) -> Column:
        n = F.lower(strip(raw))
        shared = F.size(F.array_intersect(own, tokens(n)))
        by_tokens = F.when(shared > 0, 0.4 + 0.4 * shared / F.size(F.array_distinct(tokens(n)))).otherwise(0.0)
        inside = F.contains(asked, n) | F.contains(n, asked)
        return F.when(n == "", 0.0).when(asked == n, 1.0).when(inside, 0.92).otherwise(by_tokens)

    best = F.array_max(F.transform(names, one))
    return best if similarity is None else F.greatest(best, similarity * 0.85)


def entity_hits(queries: DataFrame, entities: DataFrame, mentions: DataFrame, n: int, least: float = 0.35) -> DataFrame:
    """Chunks that mention the entities a query matches: ``query_id, id, score``; best entity per chunk, best ``n`` of each.

    ``queries``: ``query_id, group, text``; ``entities``: ``group, name, aliases``; ``mentions``: ``group, name, chunk_id``.
    The queries are the small side; entities of the query's group only are scored.
    """
    paired = entities.join(broadcast_if_small(queries.select("query_id", "group", "text")), "group")
    scored = paired.withColumn("score", F.round(entity_score(F.col("text"), F.col("name"), F.col("aliases")), 6)).filter(F.col("score") >= least)
    top = _best(scored, n, F.desc("score"), "name").select("query_id", "group", "name", "score")
    found = top.join(mentions, ["group", "name"]).groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.max("score").alias("score"))
    return _best(found, n, F.desc("score"), "id").select("query_id", "id", "score")


def expand_graph(seeds: DataFrame, relations: DataFrame, hops: int = 2, most: int = 50, decay: float = 0.6, mentions: DataFrame | None = None) -> DataFrame:
    """``query_id, id, score, hop``: chunks reached from the seeds, level by level.

    ``seeds``: ``query_id, intent, id``; ``relations``: ``src_id, dst_id, rel_type, weight``. The score of a step is the
    score so far times the weight, ``decay ** hop`` and the priority of the relation for the intent. A
    chunk belongs to the first level that reaches it, by its best path there; seeds don't come back. With ``mentions``
    (``entity_id, chunk_id``) a relation *mentions* leads to an entity and on, at .9, to every chunk that mentions it.
    """
    listed = [F.struct(F.lit(i).alias("intent"), F.lit(t).alias("rel_type"), F.lit(p).alias("priority")) for i, own in PRIORITIES.items() for t, p in own.items()]
    one = seeds.sparkSession.range(1)
    table = F.broadcast(one.select(F.explode(F.array(*listed)).alias("p")).select("p.*"))
    edges = relations.filter("dst_id IS NOT NULL").select("src_id", "dst_id", "rel_type", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    seen = seeds.select("query_id", "id").distinct()
    front = seeds.select("query_id", "intent", "id", F.lit(1.0).alias("score"))
    found: list[DataFrame] = []
    for hop in range(hops):
        step = front.join(edges, front["id"] == edges["src_id"]).join(table, ["intent", "rel_type"], "left")
        score = F.col("score") * F.col("weight") * (decay**hop) * F.coalesce("priority", F.lit(0.5))
        reached = step.select("query_id", "intent", F.col("dst_id").alias("id"), score.alias("score"), (F.col("rel_type") == "mentions").alias("named"))
        if mentions is not None:
            # The best way to each entity before its chunks, so that a frequent entity is not multiplied by its ways.
            entities = reached.filter("named").groupBy("query_id", "intent", F.col("id").alias("entity_id")).agg((F.max("score") * 0.9).alias("score"))
            onward = entities.join(mentions.select("entity_id", F.col("chunk_id").alias("id")).distinct(), "entity_id").select("query_id", "intent", "id", "score")
            reached = reached.filter("NOT coalesce(named, false)").drop("named").unionByName(onward)
        best = reached.groupBy("query_id", "intent", "id").agg(F.max("score").alias("score"))
        # Read by the result and by the next hop.
        front = written(best.join(seen, ["query_id", "id"], "left_anti").select("query_id", "intent", "id", "score"), "hop")
        found.append(front.select("query_id", "id", F.round("score", 9).alias("score"), F.lit(hop + 1).alias("hop")))
        seen = seen.unionByName(front.select("query_id", "id"))
    every = reduce(DataFrame.unionByName, found)
    return _best(every, most, "hop", F.desc("score"), "id").select("query_id", "id", "score", "hop")


def citations(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """``answer_id, no, chunk_id, first``: the numbers ``[n]`` of an answer that name one of its contexts, once, in order."""
    numbers = F.regexp_extract_all("answer", F.lit(r"\[(\d{1,9})\]"), F.lit(1))
    used = answers.select("answer_id", F.posexplode(numbers).alias("at", "no")).groupBy("answer_id", F.col("no").cast("int").alias("no")).agg(F.min("at").alias("at"))
    order = Window.partitionBy("answer_id").orderBy("at")
    known = used.join(contexts.select("answer_id", F.col("idx").alias("no"), "chunk_id"), ["answer_id", "no"])
    return known.select("answer_id", "no", "chunk_id", F.row_number().over(order).alias("first"))


def rule_scores(contexts: DataFrame, cited: DataFrame) -> DataFrame:
    """``answer_id, relevance, valid_citations``: mean of rerank (or dense) scores, share of citations that hold."""
    relevance = contexts.groupBy("answer_id").agg(F.round(F.avg(F.coalesce("rerank_score", "dense_score", F.lit(0.0))), 4).alias("relevance"))
    known = contexts.select("answer_id", F.col("idx").alias("no"), F.col("chunk_id").alias("real"))
    held = cited.join(known, ["answer_id", "no"], "left").groupBy("answer_id").agg(F.round(F.avg(F.when(F.col("real") == F.col("chunk_id"), 1.0).otherwise(0.0)), 4).alias("valid_citations"))
    return relevance.join(held, "answer_id", "left").withColumn("valid_citations", F.coalesce("valid_citations", F.lit(0.0)))


def extracted_answers(queries: DataFrame, contexts: DataFrame, least: float = 0.65, most: int = 3) -> DataFrame:
    """``query_id, idx, sentence``: the best sentence of each of the strongest contexts, by shared terms, then length.

    ``queries``: ``query_id, text``; ``contexts``: ``query_id, idx, score, content``.
    """
    terms = F.array_distinct(F.regexp_extract_all("text", F.lit("[一-鿿]{2,}|[A-Za-z0-9_]+"), F.lit(0)))
    strong = _best(contexts.filter(F.col("score") >= least), most + 1, "idx").drop("rank")
    joined = strong.join(queries.select("query_id", terms.alias("terms")), "query_id")
    sentences = F.filter(F.transform(F.split(F.coalesce("content", F.lit("")), "(?<=[。！？；;])"), strip), lambda x: x != "")
    exploded = joined.select("query_id", "idx", "terms", F.posexplode(sentences).alias("at", "sentence"))
    hits = F.size(F.filter("terms", lambda t: F.contains("sentence", t)))
    best = exploded.groupBy("query_id", "idx").agg(F.max(F.struct(hits.alias("h"), F.length("sentence").alias("l"), (-F.col("at")).alias("p"), "sentence")).alias("b"))
    return _best(best, most, "idx").select("query_id", "idx", F.left("b.sentence", F.lit(220)).alias("sentence"))


def prompts(queries: DataFrame, contexts: DataFrame, most: int = 500) -> DataFrame:
    """``query_id, prompt``: numbered sources of a query with their place and the start of their text.

    ``contexts``: ``query_id, idx, source, page, content`` (as many as a query retrieves).
    """
    line = F.concat(
        F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.coalesce("source", F.lit("")), F.lit(" P."), (F.coalesce("page", F.lit(0)) + 1).cast("string"), F.lit("\n"),
        F.left(F.coalesce("content", F.lit("")), F.lit(most)),
    )
    listed = contexts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("sources"))
    return queries.join(listed, "query_id").select("query_id", F.concat("sources", F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("prompt"))


def dense_topk(vectors: DataFrame, query: list[float], n: int, key: str, vec: str) -> DataFrame:
    """The ``n`` nearest rows of one query vector, exactly; ties by key."""
    given = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(vec, given).alias("score")).orderBy(F.desc_nulls_last("score"), key).limit(n)


def hybrid_retrieve(media: DataFrame, candidates: DataFrame, chunks: DataFrame, order: list[str], n: int = 20, least: float = 0.3) -> DataFrame:
    """``query_id, id, score, rank, route``: a query that names a figure or table is answered by ``media``, others by fusion.

    ``media``: ``query_id, id, score``; ``candidates``: ``query_id, id, score, rank, channel``. Fused candidates are folded;
    both ways add related chunks, and the best ``n`` of at least ``least`` stay. A query without any gives no row.
    """
    direct = media.select("query_id", "id", "score")
    fused = reciprocal_fusion(candidates, order).select("query_id", "id", "score")
    folded = fold_enhanced(fused, chunks).select("query_id", "id", "score").join(broadcast_if_small(direct.select("query_id").distinct()), "query_id", "left_anti")
    routes = written(direct.withColumn("route", F.lit("media")).unionByName(folded.withColumn("route", F.lit("fusion"))), "routes")
    named = routes.groupBy("query_id").agg(F.min("route").alias("route"))
    expanded = expand_related(routes.drop("route"), chunks).select("query_id", "id", "score")
    return coarse_filter(expanded, least, n).join(named, "query_id").select("query_id", "id", "score", "rank", "route")


def snapshot_roles(base: DataFrame, chunks: DataFrame, most: int = 200) -> DataFrame:
    """``query_id, id, role``: base candidates, the chunks that enhanced ones belong to, and the first ``most`` related ids of both."""
    own = chunks.select("id", "layer", "parent_id")
    hits = base.select("query_id", "id").distinct()
    folds = hits.join(own.filter("layer = 'enhanced' AND parent_id IS NOT NULL"), "id").select("query_id", F.col("parent_id").alias("id")).distinct()
    first = hits.unionByName(folds).distinct().withColumn("score", F.lit(0.0))
    related = _best(_related(first, chunks).select("query_id", "id").distinct(), most, "id").select("query_id", "id")
    roles = [df.select("query_id", "id", F.lit(role).alias("role")) for df, role in ((hits, "base"), (folds, "fold"), (related, "related"))]
    return reduce(DataFrame.unionByName, roles).join(own.select("id"), "id", "left_semi").select("query_id", "id", "role")


def snapshot_retrieve(base: DataFrame, chunks: DataFrame, n: int = 20, least: float = 0.3) -> DataFrame:
    """``query_id, id, score, rank`` from ``dense_score, sparse_score, dense_rank, sparse_rank``: scored, folded, related ones inherit."""
    folded = fold_enhanced(snapshot_score(base).select("query_id", "id", "score"), chunks).select("query_id", "id", "score")
    return coarse_filter(folded.unionByName(inherit_related(folded, chunks)), least, n)


def graph_retrieve(
    candidates: DataFrame, intents: DataFrame, chunks: DataFrame, relations: DataFrame, order: list[str], mentions: DataFrame | None = None, n: int = 5, least: float = 0.3
) -> DataFrame:
    """``query_id, id, score, rank, channel``: fused and related candidates as seeds, what the graph adds, the better score of each.

    ``candidates``: ``query_id, id, score, rank, channel``; ``intents``: ``query_id, intent``. As seeds count the best
    ``max(2 n, 10)`` of at least ``least``; the best ``n`` of both stay.
    """
    fused = reciprocal_fusion(candidates, order).select("query_id", "id", "score")
    fused = written(fused, "fused")
    seeds = written(coarse_filter(expand_related(fused, chunks).select("query_id", "id", "score"), least, max(2 * n, 10)).drop("rank"), "seeds")
    reached = expand_graph(seeds.join(broadcast_if_small(intents), "query_id").select("query_id", "intent", "id"), relations, mentions=mentions)
    both = seeds.withColumn("channel", F.lit("seed")).unionByName(reached.select("query_id", "id", "score", F.lit("graph_expand").alias("channel")))
    merged = both.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.min("channel").alias("channel"))
    return _best(merged, n, F.desc("score"), "id").select("query_id", "id", "score", "rank", "channel")


def final_prompt(query: Column | str, content: Column | str) -> Column:
    """The yes/no question about one candidate, with the first 300 characters of its text."""
    return F.concat(F.lit("以下内容是否与问题相关？问题："), query, F.lit("\n内容："), F.left(F.coalesce(content, F.lit("")), F.lit(300)), F.lit("\n只回答 yes 或 no"))


def final_check(candidates: DataFrame, answer: str = "answer") -> DataFrame:
    """The candidates whose ``answer`` doesn't say no; all of a query where none survives or a call failed (a null answer)."""
    refused = F.contains(F.lower(F.col(answer)), F.lit("no"))
    each = Window.partitionBy("query_id")
    failed = F.max(F.col(answer).isNull()).over(each)
    kept = F.max(~F.coalesce(refused, F.lit(False))).over(each)
    return candidates.withColumn("__keep", failed | ~kept | ~F.coalesce(refused, F.lit(False))).filter("__keep").drop("__keep")


def rerank_pipeline(candidates: DataFrame, chunks: DataFrame, scores: DataFrame, n: int, answers: DataFrame | None = None) -> DataFrame:
    """``query_id, id, best_child, score, rank, context``: parents of the candidates, rescored, checked, with the text around them.

    ``scores``: ``query_id, id, rerank_score`` of an outside model for the parents, where there is one; ``answers``:
    ``query_id, id, answer`` of the final check of the best ``n``. The context of a parent without children is its own text.
    """
    parents = aggregate_parents(candidates, chunks)
    top = rerank(parents, scores, n).select("query_id", "id", "best_child", F.col("final").alias("score"), "rank")
    if answers is not None:
        top = final_check(top.join(answers, ["query_id", "id"], "left")).drop("answer")
    around = context_windows(top.select("query_id", "id", "best_child"), chunks)
    own = chunks.select("id", F.coalesce("content", F.lit("")).alias("content"))
    joined = top.join(around, ["query_id", "id"], "left").join(own, "id", "left")
    return joined.select("query_id", "id", "best_child", "score", "rank", F.coalesce("context", "content", F.lit("")).alias("context"))
