"""Chunks, embeddings, vector search, conversations, agent runs, request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as X
from ..operators import vector_index as V
from ..operators.aggregates import latency_summary
from ..operators.vector import top_k
from ..plans import claims
from ..sources import sinks as K
from .registry import ARGUED_SQL, INPUTS, NEEDS, NOW, SQL_ONLY, WHITE, query

BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SQL_ONLY["chunks"] = f"""
    SELECT *, row_number() OVER (PARTITION BY source_uri ORDER BY page_number, start) - 1 AS chunk_position FROM
      (SELECT source AS source_uri, doc_id AS page_number, start, trim(substr(flat, start + 1, 1200)) AS chunk_to_retrieve FROM
        (SELECT source, doc_id, flat, unnest(range(0, length(flat), 1000)) AS start FROM
          (SELECT source, doc_id, trim(regexp_replace(text, '{BLANK}', ' ', 'g')) AS flat FROM documents)))
    WHERE length(chunk_to_retrieve) >= 100"""


def chunks(t):
    return X.chunk(t.documents, "source", "doc_id", "text")


@query("TXT-01", """
    SELECT source_uri || '::p' || page_number || '::c' || chunk_position AS chunk_id, chunk_position, source_uri, page_number,
           length(chunk_to_retrieve) AS n, md5(chunk_to_retrieve) AS digest FROM chunks""", ("chunks",))
def chunked(t):
    return chunks(t).select("chunk_id", "chunk_position", "source_uri", "page_number", F.length("chunk_to_retrieve").cast("long").alias("n"),
                            F.md5(F.col("chunk_to_retrieve").cast("binary")).alias("digest"))


@query("TXT-01-plan", f"""
    SELECT doc_id, count(*) AS n, sum(length(piece))::BIGINT AS chars FROM (SELECT doc_id, trim(substr(flat, start + 1, 500)) AS piece FROM
      (SELECT doc_id, flat, unnest(range(0, length(flat), 450)) AS start FROM
        (SELECT doc_id, trim(regexp_replace(text, '{BLANK}', ' ', 'g')) AS flat FROM documents))) WHERE length(piece) >= 100 GROUP BY 1""")
def small_chunks(t):
    c = X.chunk(t.documents, "source", "doc_id", "text", size=500, overlap=50)
    return c.groupBy(F.col("page_number").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(F.length("chunk_to_retrieve")).alias("chars"))


@query("TXT-02", """
    SELECT 'c' || doc_id || '-' || i AS chunk_id, CAST(i AS INTEGER) AS chunk_position, CASE WHEN doc_id % 2 = 0 THEN 'uri-' || doc_id ELSE 'path-' || doc_id END AS source_uri,
           CAST(doc_id % 9 AS INTEGER) AS page_number, md5(string_split(text, chr(10))[i + 1]) AS digest
    FROM (SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE n_chars >= 300)""")
def nested_chunks(t):
    lines = F.split("text", "\n")
    contents = F.transform(lines, lambda line, i: F.struct(
        F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("-"), i.cast("string")).alias("chunk_id"), i.alias("chunk_position"),
        line.alias("chunk_to_retrieve"), line.alias("chunk_to_embed"), F.array(F.struct((F.col("doc_id") % 9).alias("page_id"))).alias("pages")))
    uri = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("uri-"), F.col("doc_id").cast("string")))
    parsed = F.struct(F.when(F.col("n_chars") < 300, "unreadable").alias("error_status"),
                      F.struct(uri.alias("source_uri"), contents.alias("contents")).alias("document"))
    docs = t.documents.select(F.concat(F.lit("path-"), F.col("doc_id").cast("string")).alias("path"), F.parse_json(F.to_json(parsed)).alias("parsed"))
    out = X.chunks_from_parsed(docs, "path", "parsed")
    return out.select("chunk_id", "chunk_position", "source_uri", "page_number", F.md5(F.col("chunk_to_retrieve").cast("binary")).alias("digest"))


SQL_ONLY["words"] = r"""
    SELECT source_uri || '::p' || page_number || '::c' || chunk_position AS chunk_id, ('0x' || md5(w)[1:4])::INTEGER % 64 AS b, count(*) AS n
    FROM (SELECT *, unnest(regexp_extract_all(lower(chunk_to_retrieve), '[\p{L}\p{N}]+')) AS w FROM chunks) GROUP BY 1, 2"""
NEEDS["words"] = ["chunks"]
SQL_ONLY["asked"] = r"""
    SELECT item_id, ('0x' || md5(w)[1:4])::INTEGER % 64 AS b, count(*) AS n
    FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark) GROUP BY 1, 2"""
SQL_ONLY["hits"] = """
    SELECT item_id, chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM
      (SELECT d.item_id, d.chunk_id, round(dot / sqrt(qq) / sqrt(cc), 10) AS score FROM
        (SELECT item_id, chunk_id, sum(a.n * w.n) AS dot FROM asked a JOIN words w USING (b) GROUP BY 1, 2) d
        JOIN (SELECT item_id, sum(n * n) AS qq FROM asked GROUP BY 1) q USING (item_id)
        JOIN (SELECT chunk_id, sum(n * n) AS cc FROM words GROUP BY 1) c USING (chunk_id))"""
NEEDS["hits"] = ["asked", "words"]


@query("TXT-03", "SELECT chunk_id, count(*) AS buckets, CAST(sum(n) AS BIGINT) AS words, CAST(sum(n * b) AS BIGINT) AS weight FROM words GROUP BY 1", ("words",))
def embedded(t):
    e = X.embed(chunks(t).select("chunk_id", "chunk_to_retrieve"), "chunk_to_retrieve", X.hashed_words())
    sums = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    weight = F.aggregate(F.transform("embedding", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return e.select("chunk_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("buckets"), sums.cast("long").alias("words"),
                    weight.cast("long").alias("weight"))


@query("TXT-03-refresh", """
    SELECT w.chunk_id, c.page_number % 10 < 2 AS fresh, count(*) AS buckets, CAST(sum(n) AS BIGINT) AS words, CAST(sum(n * b) AS BIGINT) AS weight
    FROM words w JOIN (SELECT source_uri || '::p' || page_number || '::c' || chunk_position AS chunk_id, page_number FROM chunks) c USING (chunk_id)
    GROUP BY 1, 2""", ("words", "chunks"))
def refreshed(t):
    """All chunks against an earlier table in which a tenth had other texts and a tenth was missing: only those are embedded again."""
    now = chunks(t).select("chunk_id", "page_number", "chunk_to_retrieve")
    kind = F.col("page_number") % 10
    then = now.where(kind != 1).withColumn("chunk_to_retrieve", F.when(kind == 0, F.concat("chunk_to_retrieve", F.lit(" older"))).otherwise(F.col("chunk_to_retrieve")))
    path = K.scratch(t.spark, "embedded")
    none = t.spark.createDataFrame([], "chunk_id string, text_digest string, embedding array<float>")
    X.refresh_embeddings(then, none, X.hashed_words()).select("chunk_id", "text_digest", "embedding").write.parquet(path)
    e = X.refresh_embeddings(now, t.spark.read.parquet(path), X.hashed_words())
    sums = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    weight = F.aggregate(F.transform("embedding", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return e.select("chunk_id", "fresh", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("buckets"), sums.cast("long").alias("words"),
                    weight.cast("long").alias("weight"))


SQL_ONLY["topic"] = """
    SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM
      (SELECT label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1"""


@query("VEC-01", """
    SELECT label, vec_id, rank, round(s, 4) AS score FROM (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM
      (SELECT q.label, e.vec_id, round(list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])), 10) AS s FROM topic q, embeddings e)) WHERE rank <= 5""", ("topic",))
def nearest_to_topics(t):
    """The five vectors closest to the mean vector of each label, over the whole table."""
    cell = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    mean = cell.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One entry per label and dimension: bounded by the vector's length.
    topics = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    return top_k(topics, t.embeddings, 5, "label", "v", "vec_id", "embedding").withColumn("rank", F.col("rank").cast("long"))


@query("VEC-01-index", """
    SELECT label, count(*) AS n_queries, 5 * count(*) AS n_hits, true AS itself_first, true AS recalled FROM embeddings WHERE vec_id % 100 = 0 GROUP BY 1""")
def indexed_search(t):
    """Every hundredth vector looked for in a cell index of the whole table: hits, itself among the first, recall of 0.9 or more overall."""
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("asked"), "embedding")
    path = K.scratch(t.spark, "index")
    V.build_index(t.embeddings, path, 64, "vec_id")
    found = V.search_index(t.spark, path, asked, 5, q_id="asked", c_id="vec_id")
    share = V.recall(found, top_k(asked, t.embeddings, 5, "asked", "embedding", "vec_id", "embedding"), "asked", "vec_id")
    own = found.groupBy("asked").agg(F.count("*").alias("n"), F.max((F.col("asked") == F.col("vec_id")) | (F.col("score") == 1)).alias("own"))
    labels = t.embeddings.select(F.col("vec_id").alias("asked"), "label")
    return own.join(labels, "asked").groupBy("label").agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_hits"), F.min("own").alias("itself_first")).join(
        F.broadcast(share.select((F.col("recall") >= 0.9).alias("recalled"))))


@query("Q-14", "SELECT item_id, rank, chunk_id, round(score, 4) AS score FROM hits WHERE rank <= 5", ("chunks", "hits"))
def guideline_search(t):
    found = claims.rank_chunks(t.benchmark, "item_id", "text", chunks(t))
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("VEC-02", """
    SELECT item_id, count(*) AS chunks_count, string_agg(page_number, ',' ORDER BY rank) AS pages, round(max(score), 4) AS best
    FROM hits JOIN (SELECT source_uri || '::p' || page_number || '::c' || chunk_position AS chunk_id, page_number FROM chunks) USING (chunk_id)
    WHERE rank <= 5 GROUP BY 1""", ("chunks", "hits"))
def search_structs(t):
    out = claims.search(t.benchmark, "item_id", "text", chunks(t)).select("item_id", "result.*")
    return out.select("item_id", F.col("chunks_count").cast("long").alias("chunks_count"),
                      F.array_join(F.transform("chunks", lambda c: c["page_number"].cast("string")), ",").alias("pages"),
                      F.array_max(F.transform("chunks", lambda c: c["similarity_score"])).alias("best"))


# -- conversations -----------------------------------------------------------


# Conversations with figures, categories and dates, also split over turns, beside ones as they are.
INPUTS["claim_talk"] = """
    SELECT conv_id, turn, role, CASE
      WHEN role = 'user' AND conv_id % 8 = 1 THEN concat(text, ' The damage comes to about $', CAST(conv_id * 137 % 90000 AS STRING), '.50 or $', CAST(2000 + conv_id AS STRING))
      WHEN role = 'user' AND conv_id % 8 = 2 AND turn % 4 < 2 THEN concat(text, ' the loss is $ ')
      WHEN role = 'user' AND conv_id % 8 = 2 THEN concat(' ', CAST(900 + conv_id * 37 AS STRING), ',500 ', text)
      WHEN role = 'user' AND conv_id % 8 = 3 AND turn % 4 < 2 THEN concat(text, ' a FLOOD, Category')
      WHEN role = 'user' AND conv_id % 8 = 3 THEN concat(CASE WHEN conv_id % 16 = 3 THEN 'b' ELSE 'bush' END, ' it is ', text)
      WHEN role = 'assistant' AND conv_id % 8 = 3 THEN concat('A fire. category d. ', text)
      WHEN conv_id % 8 = 4 THEN concat(text, ' on 20', CAST(10 + turn AS STRING), '-0', CAST(1 + turn % 9 AS STRING), '-11 in a drought')
      WHEN role = 'assistant' AND conv_id % 8 = 5 THEN concat('$104.8 billion in all. ', text, ' cost: $7,250')
      WHEN role = 'user' AND conv_id % 8 = 5 THEN concat('$500 each. ', text)
      WHEN role = 'assistant' AND conv_id % 8 = 6 THEN concat(text, ' ', text, ' ', text, ' ', text, ' ', text, ' ', text, chr(10), 'ref 123e4567-e89b-12d3-a456-426614174000 ',
                                                             replace(text, chr(10), ' '), ' so you qualify here ', text)
      WHEN role = 'user' AND conv_id % 8 = 7 AND turn < 2 THEN concat(text, ' my claim: $')
      WHEN role = 'user' AND conv_id % 8 = 7 AND turn < 4 THEN concat('  ', chr(10))
      WHEN role = 'user' AND conv_id % 8 = 7 THEN concat('8,100.75 for it ', text)
      ELSE text END AS text FROM conversations"""

SOURCES = ("ask", "mine", "every", "agent")


def _each(form: str) -> str:
    return ", ".join(form.replace("{s}", f"coalesce({s}, '')") for s in SOURCES)


MONEY_SQL = r"try_cast(replace(regexp_extract({s}, '(?i)(?:damage|loss|estimate|claim|cost)[^\d$\n]{0,60}\$\s*([\d,]+(?:\.\d{1,2})?)', 1), ',', '') AS DOUBLE)"
LARGE_SQL = (r"list_filter(list_transform(regexp_extract_all({s}, '\$\s*([\d,]+(?:\.\d{1,2})?)', 1), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)), "
             "lambda v: v >= 1000)[1]")

@query("Q-16", rf"""
    WITH w AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS ask, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS mine,
                 string_agg(text, chr(10) ORDER BY turn) AS every, arg_max(text, turn) FILTER (role = 'assistant') AS agent FROM claim_talk GROUP BY 1),
    n AS (SELECT *, lower(every) AS b, regexp_replace(coalesce(agent, ''), '^{WHITE}|{WHITE}$', '', 'g') AS t FROM w)
    SELECT conv_id, CASE WHEN contains(b, 'flood') THEN 'flood' WHEN contains(b, 'fire') THEN 'fire' WHEN contains(b, 'storm') THEN 'storm'
             WHEN contains(b, 'earthquake') THEN 'earthquake' WHEN contains(b, 'drought') THEN 'drought' WHEN contains(b, 'cyclone') THEN 'cyclone' ELSE 'flood' END AS disaster_type,
           coalesce({_each(r"nullif(regexp_extract({s}, '\b(20\d{2}-\d{2}-\d{2})\b', 1), '')")}, '2024-01-20') AS disaster_date,
           coalesce({_each(r"upper(nullif(regexp_extract({s}, '(?i)category\s+([abcd])\b', 1), ''))")}, 'C') AS drfa_category,
           coalesce({_each(f"CASE WHEN {MONEY_SQL} >= 1000 THEN {MONEY_SQL} END")}, {_each(LARGE_SQL)}, 0) AS estimated_loss_aud,
           {ARGUED_SQL.replace("{t}", "t")} AS justification
    FROM n""", ("claim_talk",))
def claim_fields(t):
    return claims.claim_fields(t.claim_talk, today="2024-01-20")


@query("FN-25-transcript", r"""
    SELECT conv_id, count(*) AS n, md5(string_agg('  ' || role || ': ' || substr(t, 1, 300), chr(10) ORDER BY turn)) AS digest FROM
      (SELECT *, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
    WHERE rn <= 8 AND t <> '' GROUP BY 1""")
def transcripts(t):
    out = claims.transcript(t.conversations)
    # Turns may hold line breaks, so lines are counted by the role marks.
    marks = F.regexp_extract_all("transcript", F.lit(r"(?m)^  (user|assistant|system): "), 1)
    return out.select("conv_id", F.size(marks).cast("long").alias("n"), F.md5(F.col("transcript").cast("binary")).alias("digest"))


SQL_ONLY["runs"] = """
    WITH a AS (SELECT conv_id, list_sort(list(DISTINCT CASE role WHEN 'user' THEN 'verify_abn' WHEN 'assistant' THEN 'get_active_hazards' ELSE 'generate_grant_pdf' END)) AS called
               FROM conversations GROUP BY 1),
    e AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN [] ELSE ['verify_abn', 'get_industry_context'] END AS expected FROM a),
    m AS (SELECT *, list_sort(list_filter(expected, lambda x: NOT list_contains(called, x))) AS missed,
            list_filter(called, lambda x: NOT list_contains(expected, x) AND x <> 'generate_grant_pdf') AS extra, list_contains(called, 'generate_grant_pdf') AS bad FROM e)
    SELECT conv_id, CASE WHEN expected IS NULL THEN NULL WHEN len(expected) = 0 THEN 1.0 ELSE len(list_intersect(called, expected)) / 2 END AS recall,
           CASE WHEN expected IS NULL THEN NULL ELSE round(len(list_intersect(called, expected)) / len(called), 6) END AS precision,
           CASE WHEN expected IS NULL THEN NULL ELSE greatest(0, CASE WHEN len(expected) = 0 THEN 1.0 ELSE len(list_intersect(called, expected)) / 2 END
                - CASE WHEN bad THEN 0.5 ELSE 0 END) END AS score,
           CASE WHEN expected IS NULL OR NOT bad THEN '' ELSE 'generate_grant_pdf' END AS forbidden_called,
           CASE WHEN expected IS NOT NULL THEN concat_ws(' | ', 'called=[' || chr(39) || array_to_string(called, chr(39) || ', ' || chr(39)) || chr(39) || ']',
             CASE WHEN len(missed) > 0 THEN 'MISSED=[' || chr(39) || array_to_string(missed, chr(39) || ', ' || chr(39)) || chr(39) || ']' END,
             CASE WHEN bad THEN 'FORBIDDEN_CALLED=[' || chr(39) || 'generate_grant_pdf' || chr(39) || ']' END,
             CASE WHEN len(extra) > 0 THEN 'extra=[' || chr(39) || array_to_string(extra, chr(39) || ', ' || chr(39)) || chr(39) || ']' END) END AS rationale FROM m"""


def scored_runs(t):
    known = ["verify_abn", "get_active_hazards", "generate_grant_pdf"]
    tool = F.when(F.col("role") == "user", "silver__x__verify_abn").when(F.col("role") == "assistant", "a.b.get_active_hazards").otherwise("generate_grant_pdf")
    # The set of tools a run called is bounded by the known names.
    first = t.conversations.select("conv_id", tool.alias("name"), "turn").groupBy("conv_id", "name").agg(F.min("turn").alias("start"))
    runs = first.groupBy("conv_id").agg(F.collect_list(F.struct("name", F.lit("TOOL").alias("span_type"), "start")).alias("spans"))
    five = F.col("conv_id") % 5
    expected = F.when(five == 0, F.lit(None)).when(five == 1, F.array().cast("array<string>")).otherwise(
        F.array(F.lit("verify_abn"), F.lit("get_industry_context")))
    runs = claims.tools_called(runs, "conv_id", "spans", known).withColumn("expected", expected).withColumn(
        "forbidden", F.array(F.lit("generate_grant_pdf")))
    return claims.score_runs(runs)


@query("Q-28", "SELECT * FROM runs", ("runs",))
def agent_scores(t):
    return scored_runs(t).select("conv_id", "recall", F.round("precision", 6).alias("precision"), "score",
                                 F.array_join("forbidden_called", ",").alias("forbidden_called"), "rationale")


@query("Q-28-summary", """
    SELECT round(avg(recall), 6) AS avg_recall, round(avg(precision), 6) AS avg_precision, round(avg(score), 6) AS avg_score, count(*) FILTER (score = 1) AS perfect_cases,
           count(score) AS scored_cases, count(*) FILTER (score IS NULL) AS skipped_cases, count(*) FILTER (forbidden_called <> '') AS forbidden_calls FROM runs""", ("runs",))
def agent_summary(t):
    out = claims.score_summary(scored_runs(t))
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("avg") else c for c in out.columns])


@query("Q-29", """
    WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)
    SELECT event_type, count(*) AS n, round_even(round(avg(value), 6), 1) AS avg_ms, round_even(max(value), 1) AS max_ms, round_even(min(value), 1) AS min_ms,
           round_even(list_sort(list(value))[1 + CAST(floor(0.95 * count(*)) AS INTEGER)], 1) AS p95_ms FROM r GROUP BY 1""")
def latency(t):
    return latency_summary(t.events, "event_type", "value", ["ts", "event_id"], 100)


@query("AGG-16", """
    WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)
    SELECT user_id, count(*) AS n, round_even(round(avg(value), 6), 1) AS avg_ms, round_even(max(value), 1) AS max_ms, round_even(min(value), 1) AS min_ms,
           round_even(list_sort(list(value))[1 + CAST(floor(0.95 * count(*)) AS INTEGER)], 1) AS p95_ms FROM r GROUP BY 1""")
def latency_by_user(t):
    return latency_summary(t.events, "user_id", "value", ["ts", "event_id"], 1000)


DRAFT_ARGS = """
    SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN ' ' ELSE CAST(10000000000 + c_custkey AS STRING) END AS abn,
           CASE WHEN c_custkey % 10 = 2 THEN '' ELSE c_name END AS entity_name, 'NSW' AS entity_state, lpad(CAST(c_custkey AS STRING), 8, '0') AS entity_postcode,
           CASE WHEN c_custkey % 10 = 3 THEN 'meteorite' ELSE 'storm' END AS disaster_type,
           CASE WHEN c_custkey % 10 = 4 THEN '12/05/2026' ELSE '2026-05-12' END AS disaster_date,
           CASE WHEN c_custkey % 10 = 5 THEN 'E' ELSE 'B' END AS drfa_category,
           CASE WHEN c_custkey % 10 = 6 THEN -1e0 WHEN c_custkey % 10 = 7 THEN 0e0 ELSE abs(c_acctbal) END AS estimated_loss_aud,
           CASE WHEN c_custkey % 10 = 8 THEN 'too short' ELSE 'Roof torn off by wind' END AS justification
    FROM customer"""


@query("Q-15", f"""
    SELECT c_custkey, CASE WHEN c_custkey % 10 IN (1, 2, 3, 4, 5, 6, 8) THEN 'INVALID' ELSE 'DRAFT' END AS status,
           CASE WHEN c_custkey % 10 IN (1, 2, 3, 4, 5, 6, 8) THEN 0 ELSE 4 END AS steps, c_custkey % 10 IN (1, 2, 3, 4, 5, 6, 8) AS has_error, true AS in_nsw,
           disaster_type AS kind, abn, entity_name, entity_state, entity_postcode, disaster_date, drfa_category, round(estimated_loss_aud, 2) AS loss, justification,
           CASE WHEN c_custkey % 10 IN (1, 2, 3, 4, 5, 6, 8) THEN '{claims.INVALID_TEXT}' ELSE '' END AS error,
           CASE WHEN c_custkey % 10 IN (1, 2, 3, 4, 5, 6, 8) THEN '' ELSE '{'|'.join(claims.NEXT_STEPS)}' END AS todo FROM ({DRAFT_ARGS})""")
def drafts(t):
    out = claims.grant_draft(t.derive(DRAFT_ARGS), NOW, ["c_custkey"]).select("c_custkey", "draft.*")
    return out.select("c_custkey", "status", F.size("next_steps").cast("long").alias("steps"), F.col("error").isNotNull().alias("has_error"),
                      "disaster.in_nsw", F.col("disaster.type").alias("kind"), "applicant.abn", "applicant.entity_name", F.col("applicant.state").alias("entity_state"),
                      F.col("applicant.postcode").alias("entity_postcode"), F.col("disaster.date").alias("disaster_date"), "grant_request.drfa_category",
                      F.round("grant_request.estimated_loss_aud", 2).alias("loss"), "grant_request.justification", F.coalesce("error", F.lit("")).alias("error"),
                      F.array_join("next_steps", "|").alias("todo"))
