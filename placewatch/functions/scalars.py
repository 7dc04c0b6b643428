"""Scalar functions on text, numbers, times and nested values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col, let

# Words and limits that decide results.
DISASTER_WORDS = ("flood", "fire", "storm", "earthquake", "drought", "cyclone")
MONEY = r"\$\s*([\d,]+(?:\.\d{1,2})?)"
MONEY_NEAR_LOSS = r"(?i)(?:damage|loss|estimate|claim|cost)[^\d$\n]{0,60}\$\s*([\d,]+(?:\.\d{1,2})?)"
SMALLEST_CLAIM = 1000.0
ISO_DATE = r"\b(20\d{2}-\d{2}-\d{2})\b"
CATEGORY = r"(?i)category\s+([abcd])\b"
UUID = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
REASON_WORDS = r"(?:justif|recommend|claim|apply|seek|qualif|eligib)"
REASON = rf"(?is)^([^\n]{{40,800}}{REASON_WORDS}[^\n]{{0,800}})"   # 40 to 800 characters, a word, up to 800 more
REASON_LEAD = rf"(?is)^([^\n]{{40,}}?){REASON_WORDS}"


# -- times -----------------------------------------------------------------

def iso_timestamp(c: str | Column, tz: str | None = None) -> Column:
    """ISO text to a timestamp; with ``tz`` the text is local time of that zone."""
    ts = F.to_timestamp(as_col(c))
    return ts if tz is None else F.to_utc_timestamp(ts, tz)


def epoch_ms(c: str | Column) -> Column:
    return F.timestamp_millis(as_col(c).cast("long"))


def minutes_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MINUTE", as_col(start), as_col(end))


def strict_date(c: str | Column) -> Column:
    """A date only for text of the exact form yyyy-MM-dd, else NULL."""
    c = as_col(c)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


# -- numbers ---------------------------------------------------------------

def ratio(num: str | Column, den: str | Column, factor: float) -> Column:
    """``num / den * factor``; NULL unless the denominator is above zero."""
    num, den = as_col(num), as_col(den)
    return F.when((den > 0) & num.isNotNull(), num / den * F.lit(factor))


def ratio_pct(num: str | Column, den: str | Column) -> Column:
    return F.round(ratio(num, den, 100.0), 2)


def per_head(total: str | Column, heads: str | Column) -> Column:
    """Whole units per head (both sides in thousands apart); truncated, NULL on overflow."""
    total, heads = as_col(total), as_col(heads)
    return F.when((heads > 0) & total.isNotNull(),
                  (total * F.lit(1000.0) / heads).try_cast("int"))


def half_even(c: str | Column, digits: int = 0) -> Column:
    return F.bround(as_col(c), digits)


# -- identifiers -----------------------------------------------------------

def clean_abn(c: str | Column) -> Column:
    return F.regexp_replace(as_col(c), r"[\s-]", "")


def valid_abn(c: str | Column) -> Column:
    return F.coalesce(clean_abn(c).rlike(r"^\d{11}$"), F.lit(False))


def split_ids(c: str | Column) -> Column:
    """Comma list -> struct(valid, invalid): cleaned ids in their order."""
    parts = F.transform(F.split(as_col(c), ","), lambda p: F.regexp_replace(p, r"[\s-]", ""))
    # A part of blanks only is no entry; a part of dashes only is an invalid one.
    kept = F.filter(F.zip_with(F.split(as_col(c), ","), parts,
                               lambda raw, p: F.struct((F.trim(raw) != "").alias("given"), p.alias("id"))),
                    lambda s: s["given"])
    ids = F.transform(kept, lambda s: s["id"])
    return F.struct(F.filter(ids, lambda p: p.rlike(r"^\d{11}$")).alias("valid"),
                    F.filter(ids, lambda p: ~p.rlike(r"^\d{11}$")).alias("invalid"))


def padded_code(c: str | Column, width: int = 4) -> Column:
    """Numeric or text code as text with leading zeros (800 -> 0800)."""
    text = as_col(c).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def name_tail(c: str | Column) -> Column:
    """Last part of a dotted or double-underscored name."""
    return F.substring_index(F.substring_index(as_col(c), ".", -1), "__", -1)


def file_name(c: str | Column) -> Column:
    return F.regexp_extract(as_col(c), r"/([^/]+)$", 1)


def stable_id(*cols: str | Column) -> Column:
    """A repeatable id with the shape of a UUID, from the values of ``cols``."""
    h = F.md5(F.concat_ws("\u0001", *[as_col(c).cast("string") for c in cols]))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut])


# -- text ------------------------------------------------------------------

def contains_ci(c: str | Column, text: str | Column) -> Column:
    """Case-blind contains; ``%`` and ``_`` in ``text`` mean themselves."""
    text = F.lit(text) if isinstance(text, str) else text
    return F.contains(F.lower(as_col(c)), F.lower(text))


def redact_uuid(c: str | Column, mark: str = "[ref redacted]") -> Column:
    return F.regexp_replace(as_col(c), UUID, mark)


def _money(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def loss_near_word(c: str | Column) -> Column:
    """Amount of the first dollar figure that follows a damage word, else NULL."""
    hit = F.regexp_extract(as_col(c), MONEY_NEAR_LOSS, 1)
    return F.when(hit != "", _money(hit))


def first_large_amount(c: str | Column) -> Column:
    """First dollar figure of at least 1000 anywhere in the text, else NULL."""
    found = F.transform(F.regexp_extract_all(as_col(c), F.lit(MONEY), 1), _money)
    return F.get(F.filter(found, lambda v: v >= F.lit(SMALLEST_CLAIM)), F.lit(0))


def first_amount(sources: list[str | Column]) -> Column:
    """Claimed amount from texts in falling authority; the last one is the agent's.

    Three passes over the texts: a figure next to a damage word, then any large
    figure written by the user, then any large figure at all; 0 without a hit.
    """
    near = [F.when(loss_near_word(s) >= F.lit(SMALLEST_CLAIM), loss_near_word(s)) for s in sources]
    large = [first_large_amount(s) for s in sources]
    return F.coalesce(*near, *large[:-1], large[-1], F.lit(0.0))


def first_date(sources: list[str | Column]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(as_col(s), ISO_DATE, 1), F.lit("")) for s in sources])


def first_category(sources: list[str | Column]) -> Column:
    return F.coalesce(*[F.upper(F.nullif(F.regexp_extract(as_col(s), CATEGORY, 1), F.lit(""))) for s in sources])


def disaster_word(c: str | Column, default: str = "flood") -> Column:
    text = F.lower(as_col(c))
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in DISASTER_WORDS], F.lit(default))


def _reason_paragraph(text: Column) -> Column:
    """Leftmost stretch of one line around a reason word, or empty text.

    The first line with such a word at least 40 characters in holds it, and it
    begins at most 800 characters before the word; only that cut is searched.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(REASON_LEAD))

    def around(line: Column) -> Column:
        lead = F.length(F.regexp_extract(line, REASON_LEAD, 1))
        start = F.greatest(lead - 800, F.lit(0))
        return F.regexp_extract(F.substring(line, start + 1, F.lit(1640)), REASON, 1)

    return let(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), around)


def justification(c: str | Column) -> Column:
    """Short narratives whole; of long ones the paragraph that argues, else 800 characters."""
    def pick(text: Column) -> Column:
        cut = let(strip(_reason_paragraph(text)), lambda p: F.when(p != "", p).otherwise(F.substring(text, 1, 800)))
        return F.when(F.length(text) <= 800, text).otherwise(cut)

    return redact_uuid(let(strip(c), pick))


def strip(c: str | Column) -> Column:
    """Text without blanks of any kind at either end."""
    return F.regexp_replace(as_col(c), r"(?U)^\s+|\s+$", "")


def jsonp_body(c: str | Column) -> Column:
    """JSON object inside a callback wrapper: first ``{`` to last ``}``; NULL without one."""
    return F.nullif(F.regexp_extract(as_col(c), r"(?s)(\{.*\})", 1), F.lit(""))


def jsonp_to_struct(c: str | Column, schema: str) -> Column:
    return F.from_json(jsonp_body(c), schema)


def as_json(c: str | Column) -> Column:
    """Struct to JSON text that keeps NULL fields."""
    return F.to_json(as_col(c), {"ignoreNullFields": "false"})


def road_label(roads_json: str | Column) -> Column:
    """First entry of a JSON road list as ``main, suburb (near cross)``."""
    roads = F.from_json(as_col(roads_json), "array<struct<mainStreet:string,suburb:string,crossStreet:string>>")
    first = F.get(roads, F.lit(0))
    main, suburb, cross = (F.coalesce(first[f], F.lit("")) for f in ("mainStreet", "suburb", "crossStreet"))
    base = F.when((main != "") & (suburb != ""), F.concat(main, F.lit(", "), suburb)).otherwise(main)
    near = F.when(cross != "", F.concat(F.lit(" (near "), cross, F.lit(")"))).otherwise("")
    return F.concat(base, near)


def hazard_label(kind: str | Column, name: str | Column, headline: str | Column,
                 major: str | Column, network: str | Column) -> Column:
    """``type: label (major|network|active)``."""
    kind = F.coalesce(F.nullif(F.trim(as_col(kind)), F.lit("")), F.lit("hazard"))
    label = F.coalesce(F.nullif(F.trim(F.coalesce(as_col(name), as_col(headline))), F.lit("")),
                       F.replace(kind, F.lit("_"), F.lit(" ")))
    word = F.when(as_col(major), "major").when(as_col(network), "network").otherwise("active")
    return F.concat(kind, F.lit(": "), label, F.lit(" ("), word, F.lit(")"))


def context_text(level, total, at_risk, critical, pct, hazards, weather) -> Column:
    """Compact one-line text of a risk snapshot; ``hazards`` is an array, ``weather`` a struct."""
    weather = as_col(weather)
    fields = ["station", "precipitation_mm", "temperature_c", "windspeed_kmh"]
    parts = F.array_compact(F.array(*[
        F.when(weather[f].isNotNull() & (weather[f].cast("string") != ""),
               F.concat(F.lit(f + "="), weather[f].cast("string"))) for f in fields]))
    weather_text = F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("unavailable")
    hazards = F.coalesce(as_col(hazards), F.array().cast("array<string>"))
    hazard_text = F.when(F.size(hazards) > 0, F.array_join(hazards, "; ")).otherwise("no active hazards reported")
    pairs = [("overall_risk", F.coalesce(as_col(level), F.lit("Unknown"))), ("total_cells", total),
             ("at_risk_cells", at_risk), ("critical_cells", critical), ("risk_pct", pct)]
    texts = [F.concat(F.lit(k + "="), F.coalesce(as_col(v).cast("string"), F.lit("0"))) for k, v in pairs]
    return F.concat_ws("; ", *texts, F.concat(F.lit("active_hazards="), hazard_text),
                       F.concat(F.lit("weather="), weather_text))
