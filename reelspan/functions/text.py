"""Text and time expressions: normalisation, timestamps, line balance, counts, sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def each(rows: DataFrame, keys: list, items, names: tuple[str, ...]) -> DataFrame:
    """The keys with a row for each item of an array, (place, item) or item by the number of names.

    An outer explode and a test of what it gives: for a plain explode the
    optimizer tests the array's size below, which computes a long expression again.
    """
    made = (F.posexplode_outer if len(names) == 2 else F.explode_outer)(items).alias(*names)
    return rows.select(*keys, made).where(F.col(names[-1]).isNotNull())


#: Items that a running sum takes at a time.
BLOCK = 128


def once(value: Column, use) -> Column:
    """use(value), with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(sizes: Column, first: Column | int = 0) -> Column:
    """first, first + sizes[0], …: where each item begins, and where the last ends. In blocks, as a fold copies what it has gathered at each step."""
    begin = F.lit(first) if isinstance(first, int) else first
    grow = lambda xs, x: F.aggregate(xs, F.array(x), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))

    def placed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda a, n: a + n))
        inner = lambda ends: F.zip_with(blocks, F.slice(ends, F.lit(1), F.size(blocks)), lambda xs, x: F.slice(grow(xs, x), F.lit(1), F.size(xs)))
        return once(grow(totals, begin), lambda ends: F.concat(F.flatten(inner(ends)), F.slice(ends, -1, 1)))

    return once(sizes, lambda xs: once(cut(xs), placed))


SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalized(text: Column) -> Column:
    """White space collapsed, none before closing punctuation, none at the ends."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, SPACE, " ")), r" +([,.;:!?])", "$1"))


def tight(line: Column) -> Column:
    """Words joined by spaces as a line: no space before closing or after opening marks."""
    return F.regexp_replace(F.regexp_replace(line, r" +([,.;:!?%\])])", "$1"), r"([\[(]) +", "$1")


def micros(x: Column) -> Column:
    """Seconds as whole microseconds, half to even."""
    return F.bround(x * 1e6).cast("bigint")


def millis(seconds: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.bround(seconds * 1000).cast("bigint"))


def _div(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("bigint")


def timestamp(seconds: Column, srt: bool = False) -> Column:
    """HH:MM:SS.mmm (comma for subtitles); negative times count as zero and hours may exceed 99."""
    ms = millis(seconds)
    return F.format_string(f"%02d:%02d:%02d{',' if srt else '.'}%03d", _div(ms, 3_600_000), _div(ms % 3_600_000, 60_000), _div(ms % 60_000, 1000), ms % 1000)


def clock(seconds: Column) -> Column:
    """The timestamp without its milliseconds, cut after rounding to them."""
    return F.substring_index(timestamp(seconds), ".", 1)


def ass_time(seconds: Column) -> Column:
    cs = F.greatest(F.lit(0).cast("bigint"), F.bround(seconds * 100).cast("bigint"))
    return F.format_string("%d:%02d:%02d.%02d", _div(cs, 360_000), _div(cs % 360_000, 6000), _div(cs % 6000, 100), cs % 100)


def balanced_lines(text: Column, width: int = 42) -> Column:
    """Text of more than ``width`` characters as two lines: least overflow, then least difference, then the least pair."""
    line = F.trim(F.regexp_replace(text, SPACE, " "))

    def cut(x: Column) -> Column:
        # where each word but the first begins; of equal cuts the earliest has the least pair, as its left is a prefix
        def best(begins: Column) -> Column:
            def weigh(at: Column) -> Column:
                left, right = at - 1, F.length(x["line"]) - at
                return F.struct((F.greatest(F.lit(0), left - width) + F.greatest(F.lit(0), right - width)).alias("o"), F.abs(left - right).alias("d"), at.alias("at"))

            return F.array_min(F.transform(F.slice(begins, F.lit(2), F.size(begins) - 2), weigh))["at"]

        at = once(running(F.transform(x["words"], lambda w: F.length(w) + 1)), best)
        two = once(at, lambda p: F.concat(F.substring(x["line"], F.lit(1), p - 1), F.lit("\n"), F.substring(x["line"], p + 1, F.length(x["line"]))))
        return F.when(F.size(x["words"]) < 2, x["text"]).otherwise(two)

    return F.when(F.length(text) <= width, text).otherwise(once(line, lambda y: once(F.struct(text.alias("text"), y.alias("line"), F.split(y, " ").alias("words")), cut)))


def ass_text(text: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\⁠")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    return F.replace(balanced_lines(escaped), F.lit("\n"), F.lit("\\N"))


def technical_shape(form: Column) -> Column:
    """A letter, and: several letters all upper case, or a digit, or an upper-case letter after the first character, or one of +/#_.-"""
    letters = F.regexp_replace(form, r"[^\p{L}]", "")
    upper = (F.length(letters) >= 2) & ~letters.rlike(r"[^\p{Lu}]")
    return (F.length(letters) > 0) & (upper | form.rlike(r"\p{Nd}") | F.substring(form, 2, 1_000_000).rlike(r"\p{Lu}") | form.rlike(r"[+/#_.\-]"))


def english_words(text: Column) -> Column:
    """English words of a text; letters and digits of any script bound them."""
    edge = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
    return F.size(F.regexp_extract_all(text, F.lit(rf"{edge}[A-Za-z0-9][A-Za-z0-9_./+#'-]*{edge}"), F.lit(0))).cast("bigint")


def prompt_tokens_of(characters: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(characters / 2.8).cast("bigint"))


def prompt_tokens(text: Column) -> Column:
    return prompt_tokens_of(F.length(text))


def safe_stem(name: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_\-]", "_"), r"^_+|_+$", "")
    return F.when(cleaned == "", F.lit("video")).otherwise(cleaned)


def summary_targets(words: Column, windows: Column) -> dict[str, Column]:
    """Word and paragraph targets of a summary, from the source's words and prompt windows."""
    up = lambda x: F.ceil(x).cast("bigint")
    low = up(F.lit(0.20) * words / 100) * 100
    high = up(F.lit(0.27) * words / 100) * 100
    least = F.least(F.lit(2200), F.greatest(F.lit(1200), low)).cast("bigint")
    most = F.least(F.lit(2600), F.greatest(least + 400, high)).cast("bigint")
    groups = F.greatest(F.lit(10), F.least(F.lit(18), F.greatest(windows + 2, F.bround(least / 120)))).cast("bigint")
    return {"words_min": least, "words_max": most, "groups_min": groups, "groups_max": F.greatest(groups + 4, F.least(F.lit(22), F.ceil(most / 100))).cast("bigint")}


def output_budget(words_max: Column, cap: int = 16384) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(8192), F.ceil((2 * words_max + 1024) / 2048) * 2048)).cast("bigint")


def stage_context(estimate: Column, output: Column, context: int = 65536) -> Column:
    """The context size of a stage, null if the prompt can't fit."""
    fits = estimate <= context - output - 1024
    return F.when(fits, F.least(F.lit(context), F.greatest(F.lit(8192), F.ceil((estimate + output + 1024) / 2048) * 2048)).cast("bigint"))


def memory_gib(context: Column) -> Column:
    return 18 + F.lit(4.2) * context / 8192 + 4


def fixed_micros(x: Column) -> Column:
    """A number of 0 or more with six decimals, rounded from its exact binary value (half to even).

    format_string rounds the shortest decimal form instead, which differs at
    ties. The error of the product is computed exactly from two halves of x.
    """
    high = x * 134217729.0 - (x * 134217729.0 - x)
    product = x * 1e6
    error = (high * 1e6 - product) + (x - high) * 1e6
    whole = F.floor(product)
    beyond = (product - whole - 0.5) + error
    n = whole + F.when((beyond > 0) | ((beyond == 0) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(_div(n, 1_000_000).cast("string"), F.lit("."), F.lpad((n % 1_000_000).cast("string"), 6, "0"))
