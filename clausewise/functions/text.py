"""Text helpers: normalising, HTML and reply clean-up, JSON salvage, number and money formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.functions.maths import half_up


# Unicode white space, as (?U)\s has it, but listed: the engine looks every character up otherwise
BLANKS = r"\t-\r\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
RUNS = f"[{BLANKS}][ {BLANKS}]*| [ {BLANKS}]+"  # white space that is not just one blank
WORD = f"[^ {BLANKS}]+"


def normalise(text: Column, whitespace: bool = True, lower: bool = True) -> Column:
    """Collapse runs of Unicode white space, trim, lower-case; each step can be switched off."""
    if whitespace:
        text = F.trim(F.regexp_replace(text, RUNS, " "))
    return F.lower(text) if lower else text


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def strip_html(html: Column) -> Column:
    """Visible text of a page: scripts and styles dropped, tags to blanks, runs of blanks collapsed."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>", "")
    text = F.regexp_replace(text, r"(?is)<style.*?</style>", "")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(text, r"\s{2,}", " "))


def strip_thinking(reply: Column) -> Column:
    return F.trim(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""))


def strip_fence(reply: Column) -> Column:
    opened = F.regexp_replace(reply, r"^```(?:json)?\n?", "")
    return F.trim(F.regexp_replace(opened, r"\n?```$", ""))


def salvage_json(reply: Column, schema: str) -> Column:
    """Parse a reply as JSON; if that fails, parse the outermost brace block found in it; else null."""
    braces = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    options = {"mode": "PERMISSIVE"}
    whole = F.when(F.get_json_object(reply, "$").isNotNull(), F.from_json(reply, schema, options))
    inner = F.when(F.get_json_object(braces, "$").isNotNull(), F.from_json(braces, schema, options))
    return F.coalesce(whole, inner)


def readable_label(label: Column) -> Column:
    return F.replace(label, F.lit("_"), F.lit(" "))


def title_words(label: Column) -> Column:
    """Underscores to blanks, first letter of every word raised, the rest left as it is."""
    words = F.split(readable_label(label), r"\b(?=\w)")
    raised = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.array_join(raised, "")


def plain_number(x: Column) -> Column:
    """Shortest decimal form: whole numbers without a fraction, others with the digits they need (up to 6)."""
    whole = x == F.floor(x)
    digits = F.rtrim(F.rtrim(x.try_cast("decimal(38,6)").cast("string"), F.lit("0")), F.lit("."))
    fraction = F.coalesce(digits, F.format_string("%.6f", x))  # no number, or infinite
    return F.when(whole, F.floor(x).cast("bigint").cast("string")).otherwise(fraction)


def grouped_int(x: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(x.cast("bigint"), 0)


def money(x: Column) -> Column:
    """``$1,235 CAD``: sign dropped, rounded to the dollar."""
    return F.concat(F.lit("$"), grouped_int(half_up(F.abs(x))), F.lit(" CAD"))


def value_with_unit(x: Column, unit: Column) -> Column:
    return (
        F.when(unit == "percent", F.concat(plain_number(x), F.lit("%")))
        .when(unit == "CAD", money(x))
        .when(unit.isNotNull(), F.concat_ws(" ", plain_number(x), unit))
        .otherwise(plain_number(x))
    )


def cell_money(x: Column) -> Column:
    """Table cell: signed dollars with the currency name; null shows as zero."""
    rounded = F.when(x < 0, -F.floor(F.abs(x) + 0.5)).otherwise(F.floor(x + 0.5))
    text = F.concat(F.when(rounded < 0, "-$").otherwise("$"), grouped_int(F.abs(rounded)), F.lit(" CAD"))
    return F.when(x.isNull(), "$0 CAD").otherwise(text)


def cell_percent(x: Column) -> Column:
    return F.when(x.isNull(), "0%").otherwise(F.concat(F.format_number(x, 2), F.lit("%")))


def cell_delta(delta: Column, unit: Column) -> Column:
    """Signed difference: percentage points, dollars, or number with its unit."""
    kind = F.lower(unit)
    sign = F.when(delta > 0, "+").otherwise("")
    dollars = F.concat(
        F.when(delta > 0, "+$").otherwise("-$"), grouped_int(F.floor(F.abs(delta) + 0.5))
    )
    other = F.trim(F.concat(sign, plain_number(delta), F.lit(" "), F.coalesce(unit, F.lit(""))))
    return (
        F.when(delta.isNull(), "")
        .when(kind.isin("percent", "percentage"), F.concat(sign, F.format_number(delta, 2), F.lit(" pp")))
        .when(kind.isin("cad", "$"), dollars)
        .otherwise(other)
    )


def paragraphs(summary: Column) -> Column:
    """Non-blank paragraphs of a summary as an array."""
    return F.filter(F.split(summary, r"\n\s*\n"), lambda p: p.rlike(r"(?U)\S"))
