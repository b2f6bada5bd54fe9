"""Column functions: ticker and date cleaning, numeric coercion, stable rounding, guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from alphaloom.operators.ranks import dealt, must_spread, spread_ranks

# Texts that stand for a missing number; none has the form of one.
MISSING_NUMBERS = ["", "-", "--", "N/A", "<NA>", "nan", "None"]
SUFFIX = ".TW"
#: A decimal number; a cast alone would also read suffixes ("12d") and hexadecimals.
_NUMBER = r"(?i)^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?$|^[+-]?inf(?:inity)?$"
HIGHER, LOWER = "higher_is_better", "lower_is_better"


def clean_ticker(c: Column) -> Column:
    """First run of digits of the trimmed, upper-cased text; without digits the text less the exchange suffix; null stays null."""
    text = F.upper(F.trim(c.cast("string")))
    return F.when(text.rlike(r"\d"), F.regexp_extract(text, r"(\d+)", 1)).otherwise(F.replace(text, F.lit(SUFFIX), F.lit("")))


def suffix_ticker(c: Column, suffix: str = SUFFIX) -> Column:
    """The exchange symbol: kept if it has the suffix already, else the clean ticker with it."""
    text = F.upper(F.trim(c.cast("string")))
    return F.when(text.endswith(suffix), text).otherwise(F.concat(clean_ticker(c), F.lit(suffix)))


def numeric(c: Column) -> Column:
    """A double; thousands separators go, missing and unreadable values become null, and so does NaN: none of them has the form of a number. Nothing else is asked, so that a row's numbers are code small enough for the JVM to compile."""
    text = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(""))
    return F.when(text.rlike(_NUMBER), text).try_cast("double")


_CLOCK = r"(?:[ T]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?\s*$"
_YEAR_FIRST = r"^\s*([0-9]{4})[/.-]([0-9]{1,2})[/.-]([0-9]{1,2})" + _CLOCK
_YEAR_LAST = r"^\s*([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4}|[0-9]{2})" + _CLOCK
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + r")\.?"
_WORDED = [rf"(?i)^\s*(?:[a-z]+,\s*)?{_MONTH}[\s-]+([0-9]{{1,2}}),?[\s-]+([0-9]{{4}}){_CLOCK}", rf"(?i)^\s*(?:[a-z]+,\s*)?([0-9]{{1,2}})[\s-]+{_MONTH},?[\s-]+([0-9]{{4}}){_CLOCK}"]


#: ``$`` may stand before a line end that ``\s`` does not take.
_END = r"[\u0085\u2028\u2029]?"
_COMPACT = r"^[+-]?[0-9]{8,}$"


def day_first(c: Column) -> Column:
    """An aggregate: is the first of two leading numbers the day in this column? It is where more values can be read that way; month first otherwise."""
    text = c.cast("string")
    number, month = "([0-9]{1,2})", "(0?[0-9]|1[0-2])"
    first, second = _YEAR_LAST.replace(number, month, 1), month.join(_YEAR_LAST.rsplit(number, 1))
    return F.coalesce(F.count_if(text.rlike(second)) > F.count_if(text.rlike(first)), F.lit(False))


def to_date_lenient(c: Column, days_lead: Column | bool = False) -> Column:
    """A date from yyyyMMdd, ISO text, numbers between slashes, dots or dashes, or a month's name; a time of day may follow. Unreadable values become null.

    Where the year is last, ``days_lead`` tells which of the other two numbers is the day; ``day_first`` finds that for a column.
    A form's parts are taken out only of texts that have it, and no parser meets a text that it can but throw at.
    """
    text = c.cast("string")
    lead = F.lit(days_lead) if isinstance(days_lead, bool) else days_lead

    def date(pattern: str, order: Column) -> Column:
        return F.when(text.rlike(pattern), F.try_to_timestamp(F.regexp_replace(text, F.lit(pattern + _END), order)))

    def worded(pattern: str, month: int, day: int) -> Column:
        name = F.lower(F.substring(F.regexp_extract(text, pattern, month), 1, 3))
        number = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), name).cast("string")
        return F.when(text.rlike(pattern), F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(text, pattern, 3), number, F.regexp_extract(text, pattern, day))))

    two = lambda years: _YEAR_LAST.replace("([0-9]{4}|[0-9]{2})", f"({years})")
    numbered = [date(two(years), F.when(lead, f"{century}$3-$2-$1").otherwise(f"{century}$3-$1-$2")) for years, century in (("[0-9]{4}", ""), ("[0-5][0-9]|6[0-8]", "20"), ("69|[7-9][0-9]", "19"))]
    compact = F.when(text.rlike(_COMPACT), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    return F.coalesce(compact, F.try_to_timestamp(text), date(_YEAR_FIRST, F.lit("$1-$2-$3")), *numbered, worded(_WORDED[0], 1, 2), worded(_WORDED[1], 2, 1)).cast("date")


def rounded(c: Column, digits: int = 6) -> Column:
    """Half-up by one multiplication and a floor, so that every engine gets the same bits; never minus zero."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / F.lit(scale)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def _places(value: Column, by: list[Column | str], descending: bool) -> WindowSpec:
    """A group in the order of its values, nulls behind: all that ranks need is one window, so a group is dealt out and sorted once."""
    return Window.partitionBy(*by).orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last())


def average_rank(value: Column, by: list[Column | str], descending: bool = False) -> Column:
    """Rank with ties averaged among the non-null values of a group; null for null."""
    places = _places(value, by, descending)
    last = F.count(F.lit(1)).over(places.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(value.isNotNull(), (F.rank().over(places) + last) / 2.0)


def pct_rank(value: Column, by: list[Column | str], direction: str = HIGHER) -> Column:
    """Cross-sectional percentile rank: average rank over the number of non-null values; the best value has 1. A group is sorted by one task."""
    if direction not in (HIGHER, LOWER):
        raise ValueError(f"Unsupported direction: {direction}")
    every = _places(value, by, direction == LOWER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return average_rank(value, by, direction == LOWER) / F.count(value).over(every)


def with_pct_ranks(df: DataFrame, by: list[str], values: dict[str, tuple[str, str]], spread: bool | None = None) -> DataFrame:
    """``df`` with percentile ranks: output name to value column and direction. Groups beyond a task's size are ranked by ranges; ``spread`` forces that or rules it out."""
    for _, direction in values.values():
        if direction not in (HIGHER, LOWER):
            raise ValueError(f"Unsupported direction: {direction}")
    if not (must_spread(df, by) if spread is None else spread):
        return dealt(df, by).select("*", *(pct_rank(F.col(v), by, d).alias(out) for out, (v, d) in values.items()))
    for out, (v, d) in values.items():
        columns = df.columns
        df = spread_ranks(df, by, v, d == LOWER).select(*columns, (F.col("_average") / F.col("_count")).alias(out))
    return df


def rank_factor(df: DataFrame, value: str, by: str = "date", direction: str = HIGHER, spread: bool | None = None) -> DataFrame:
    """``df`` with column rank. Values are rounded to ten digits first, so that ties do not hang on summation order."""
    return with_pct_ranks(df.withColumn("_v", rounded(F.col(value), 10)), [by], {"rank": ("_v", direction)}, spread).drop("_v")
