"""Documents, grant drafts, claim fields from conversations, agent scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import (CATEGORY, DISASTER_WORDS, ISO_DATE, SMALLEST_CLAIM, first_large_amount,
                                 justification, loss_near_word, name_tail, stable_id, strict_date, strip)
from ..operators.history import collect_top, top_per_key
from ..operators.reshape import set_overlap
from ..operators.text import embed, hashed_words
from ..operators.vector import search_result, top_k

# The end of a text that only lacks what a pattern asks for behind white space, and such a start of the next text.
LEAD, HEAD = r"(?:\$|(?i:category))\s*$", r"^\s*([\d,]+(?:\.\d{1,2})?|[A-Da-d]\b)"

# Texts of a draft.
NEXT_STEPS = ("Review the draft for accuracy",
              "Attach disaster damage evidence (photos, repair quotes, insurance records)",
              "Confirm the DRFA category cites the right authority",
              "Submit to NEMA via the official portal")
INVALID_TEXT = ("One or more inputs invalid. Check abn, entity_name, disaster_type "
                "(flood/fire/storm/earthquake/drought/cyclone), disaster_date (YYYY-MM-DD), drfa_category (A/B/C/D), "
                "estimated_loss_aud (positive number), and justification (at least 10 characters).")


def search(questions: DataFrame, q_id: str, question: str, chunks: DataFrame, k: int = 5,
           encoder=None) -> DataFrame:
    """(q_id, result): the ``k`` chunks closest to each question, as one struct per question."""
    encoder = encoder or hashed_words()
    hits = rank_chunks(questions, q_id, question, chunks, k, encoder)
    texts = hits.join(chunks.drop("embedding"), "chunk_id")
    return search_result(texts, questions, q_id, question, k)


def rank_chunks(questions: DataFrame, q_id: str, question: str, chunks: DataFrame, k: int = 5,
                encoder=None) -> DataFrame:
    """(q_id, chunk_id, rank, score) of the ``k`` closest chunks; embeds what has no embedding yet."""
    encoder = encoder or hashed_words()
    asked = embed(questions.select(q_id, question), question, encoder).select(q_id, "embedding")
    if "embedding" not in chunks.columns:
        chunks = embed(chunks.select("chunk_id", "chunk_to_retrieve"), "chunk_to_retrieve", encoder)
    return top_k(asked, chunks, k, q_id, "embedding", "chunk_id", "embedding")


def draft_status(abn, entity_name, disaster_type, disaster_date, category, loss, why, strict: bool = True) -> Column:
    """DRAFT when every argument is usable, else INVALID."""
    filled = [F.coalesce(F.length(F.trim(c)) > 0, F.lit(False)) for c in (abn, entity_name)]
    day = strict_date(disaster_date) if strict else disaster_date.try_cast("date")
    # An unknown (NULL) kind or category does not count against a draft, as in a NOT IN test.
    fine = (filled[0] & filled[1]
            & F.coalesce(disaster_type.isin(*DISASTER_WORDS), F.lit(True))
            & F.coalesce(category.isin("A", "B", "C", "D"), F.lit(True))
            & day.isNotNull() & F.coalesce(loss >= 0, F.lit(False))
            & F.coalesce(F.length(F.trim(why)) >= 10, F.lit(False)))
    return F.when(fine, "DRAFT").otherwise("INVALID")


def grant_draft(df: DataFrame, now, keep: list[str] | None = None, strict: bool = False,
                random_ids: bool = False) -> DataFrame:
    """A draft struct per row of arguments: abn, entity_name, entity_state, entity_postcode,
    disaster_type, disaster_date, drfa_category, estimated_loss_aud, justification."""
    c = {n: F.col(n) for n in ("abn", "entity_name", "entity_state", "entity_postcode", "disaster_type",
                               "disaster_date", "drfa_category", "estimated_loss_aud", "justification")}
    status = draft_status(c["abn"], c["entity_name"], c["disaster_type"], c["disaster_date"], c["drfa_category"],
                          c["estimated_loss_aud"], c["justification"], strict)
    made = F.uuid() if random_ids else stable_id(*c, F.lit(str(now)))
    df = df.withColumn("_status", status)
    draft = F.col("_status") == "DRAFT"
    return df.select(*(keep or []), F.struct(
        made.alias("application_id"), F.lit(str(now)).cast("timestamp").alias("draft_timestamp"),
        F.struct(c["abn"], c["entity_name"], c["entity_state"].alias("state"),
                 c["entity_postcode"].alias("postcode")).alias("applicant"),
        F.struct(c["disaster_type"].alias("type"), c["disaster_date"].alias("date"),
                 (c["entity_state"] == "NSW").alias("in_nsw")).alias("disaster"),
        F.struct(c["drfa_category"], c["estimated_loss_aud"], c["justification"]).alias("grant_request"),
        F.col("_status").alias("status"),
        F.when(draft, F.array(*[F.lit(s) for s in NEXT_STEPS])).otherwise(
            F.array().cast("array<string>")).alias("next_steps"),
        F.when(~draft, F.lit(INVALID_TEXT)).alias("error")).alias("draft"))


def claim_fields(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", today: str = "1970-01-01") -> DataFrame:
    """Claim fields per conversation; what the user wrote wins over the agent.

    The user's last turn is the request, the agent's last turn the narrative,
    the user's turns and all turns, each joined by line breaks, are the history.
    Each field is found inside a turn, or where a turn ends with a lead (a
    dollar sign, the word category) that the next turn with any text completes;
    the first finding by authority and turn is kept, so no conversation is
    gathered whole.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = turns.select(F.col(conv), F.col(turn).alias("_o"), F.col(role).alias("_r"), t.alias("_t"))
    # What a turn starts with, NULL for a blank one: it completes the lead of the nearest turn before that is not blank.
    head = F.when(F.col("_t").rlike(r"\S"), F.regexp_extract("_t", HEAD, 1))
    backwards = Window.orderBy(F.desc("_o")).rowsBetween(Window.unboundedPreceding, -1)
    lead = F.col("_t").rlike(LEAD)
    joined = own.withColumn("_h", head).select(
        "*", F.when(lead, F.concat("_t", F.lit("\n"), F.last("_h", ignorenulls=True).over(backwards.partitionBy(conv)))).alias("_t_all"),
        F.when(lead, F.concat("_t", F.lit("\n"), F.last("_h", ignorenulls=True).over(backwards.partitionBy(conv, F.col("_r") == "user")))).alias("_t_user"))

    def fields(t: Column) -> list[Column]:
        return [loss_near_word(t), first_large_amount(t), F.nullif(F.regexp_extract(t, ISO_DATE, 1), F.lit("")),
                F.upper(F.nullif(F.regexp_extract(t, CATEGORY, 1), F.lit("")))]

    names = ("_near", "_large", "_date", "_cat")
    plain = joined.select(conv, "_o", "_r", "_t", "_t_all", "_t_user",
                          *[c.alias(n) for c, n in zip(fields(F.col("_t")), names, strict=True)],
                          *[F.contains(F.lower("_t"), F.lit(w)).alias(f"_w_{w}") for w in DISASTER_WORDS])
    found = plain.select("*", *[F.when(F.col(f"_t_{s}").isNull(), F.col(n)).otherwise(c).alias(f"{n}_{s}")
                                for s in ("user", "all") for c, n in zip(fields(F.col(f"_t_{s}")), names, strict=True)])
    mine, theirs = F.col("_r") == "user", F.col("_r") == "assistant"

    def earliest(value: str, who: Column | None = None) -> Column:
        hit = F.col(value).isNotNull() if who is None else F.col(value).isNotNull() & who
        return F.min_by(F.when(hit, F.col(value)), F.when(hit, F.col("_o")))

    def last(value: str, who: Column) -> Column:
        return F.max_by(F.when(who, F.col(value)), F.when(who, F.col("_o")))

    aggs = []
    for v in ("_near", "_large", "_date", "_cat"):
        aggs += [last(v, mine).alias(f"{v}_ask"), earliest(f"{v}_user", mine).alias(f"{v}_user"),
                 earliest(f"{v}_all").alias(f"{v}_all"), last(v, theirs).alias(f"{v}_agent")]
    words = [F.max(F.col(f"_w_{w}")).alias(f"_w_{w}") for w in DISASTER_WORDS]
    per = found.groupBy(conv).agg(*aggs, *words, last("_t", theirs).alias("_narrative"))
    # A figure beside a damage word counts from each text only if it is large enough.
    authority = ("ask", "user", "all", "agent")
    near = [F.when(F.col(f"_near_{s}") >= F.lit(SMALLEST_CLAIM), F.col(f"_near_{s}")) for s in authority]
    large, dates, cats = ([F.col(f"{v}_{s}") for s in authority] for v in ("_large", "_date", "_cat"))
    return per.select(
        conv, F.coalesce(*[F.when(F.col(f"_w_{w}"), F.lit(w)) for w in DISASTER_WORDS], F.lit("flood")).alias("disaster_type"),
        F.coalesce(*dates, F.lit(today)).alias("disaster_date"),
        F.coalesce(*cats, F.lit("C")).alias("drfa_category"),
        F.coalesce(*near, *large, F.lit(0.0)).alias("estimated_loss_aud"),
        justification(F.coalesce("_narrative", F.lit(""))).alias("justification"))


def transcript(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               last_n: int = 8, chars: int = 300) -> DataFrame:
    """The last turns of each conversation as one text, each cut to ``chars`` characters."""
    body = strip(F.coalesce(F.col(text), F.lit("")))
    line = F.concat(F.lit("  "), F.col(role), F.lit(": "), F.substring(body, 1, chars))
    cut = top_per_key(turns.select(conv, turn, line.alias("line"), (body != "").alias("said")), [conv], [F.desc(turn)], last_n)
    lines = collect_top(cut.where("said"), [conv], [turn], last_n, ["line"], "lines")
    return lines.select(conv, F.array_join(F.transform("lines", lambda s: s["line"]), "\n").alias("transcript"))


def tools_called(runs: DataFrame, case: str, spans: str, known: list[str]) -> DataFrame:
    """Names of the known tools a run called, in order of start time, out of its spans.

    ``spans`` is an array of struct(name, span_type, start). A span typed TOOL or
    named like a known tool counts; qualified names are cut to their tail.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), name_tail(s["name"]).alias("tool"))))
    tools = F.transform(F.filter(ordered, lambda s: s["tool"].isin(*known)), lambda s: s["tool"])
    return runs.withColumn("actual", tools)


def score_runs(runs: DataFrame, actual: str = "actual", expected: str = "expected",
               forbidden: str = "forbidden") -> DataFrame:
    """Scores of each run and their ``rationale`` in words; a run without a score has none."""
    scored = runs.withColumn("_s", set_overlap(actual, expected, forbidden)).select(*runs.columns, "_s.*")

    def listed(tools: Column) -> Column:
        return F.concat(F.lit("['"), F.array_join(F.array_sort(tools), "', '"), F.lit("']"))

    parts = [F.concat(F.lit("called="), F.when(F.size(actual) > 0, listed(F.array_distinct(actual))).otherwise("∅"))]
    parts += [F.when(F.size(c) > 0, F.concat(F.lit(f"{name}="), listed(F.col(c))))
              for name, c in (("MISSED", "missed"), ("FORBIDDEN_CALLED", "forbidden_called"), ("extra", "extra"))]
    return scored.withColumn("rationale", F.when(F.col("score").isNotNull(), F.concat_ws(" | ", *parts)))


def score_summary(scored: DataFrame) -> DataFrame:
    """Averages over the scored runs and counts of perfect, skipped and forbidden ones."""
    return scored.agg(
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("avg_recall"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("avg_precision"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
        F.count_if(F.col("score") == 1.0).alias("perfect_cases"), F.count("score").alias("scored_cases"),
        F.count_if(F.col("score").isNull()).alias("skipped_cases"),
        F.count_if(F.size("forbidden_called") > 0).alias("forbidden_calls"))
