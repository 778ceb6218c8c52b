"""Display text: made safe, clipped, counted and abbreviated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_KEY = 4096
MESSAGE, MESSAGE_TAIL = 200, 80
NO_MODEL = "(no model)"
# The spellings of "no model".
NO_MODEL_SPELLINGS = ("", "unknown", "<synthetic>", "—")
_UNSAFE = r"[\p{Cc}‪-‮⁦-⁩]"
_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
_GLYPHS = "▁▂▃▄▅▆▇█"


def bounded_key(c: Column) -> Column:
    return F.substring(c, 1, MAX_KEY)


def safe_text(c: Column) -> Column:
    """Control characters and direction overrides become a middle dot."""
    return F.regexp_replace(c, _UNSAFE, "·")


def neutral_cell(c: Column) -> Column:
    """A leading formula sign gets an apostrophe unless the cell is a number."""
    return F.when(c.rlike(r"^[=+\-@]") & ~c.rlike(_NUMBER), F.concat(F.lit("'"), c)).otherwise(c)


def safe_message(c: Column, most: int = MESSAGE, tail: int = MESSAGE_TAIL) -> Column:
    """Long messages lose their middle."""
    clipped = F.concat(
        safe_text(F.substring(c, 1, most - tail - 1)), F.lit("…"), safe_text(F.substring(c, F.length(c) - tail + 1, F.lit(tail)))
    )
    return F.when(F.length(c) <= most, safe_text(c)).otherwise(clipped)


def left_clipped(c: Column, width: int = 38) -> Column:
    """Text for a column of fixed width; the end is what stays."""
    safe = safe_text(c)
    return F.when(F.length(safe) <= width, safe).otherwise(F.concat(F.lit("…"), F.right(safe, F.lit(width - 1))))


def hours(seconds: Column) -> Column:
    whole = F.greatest(F.round(seconds), F.lit(0)).cast("long")
    return F.concat(
        F.floor(whole / 3600).cast("string"), F.lit("h "), F.lpad(F.floor(whole % 3600 / 60).cast("string"), 2, "0"), F.lit("m")
    )


def compact_count(n: Column, most: str = "B") -> Column:
    """1234 as 1.2k, then M and B; with ``most`` M millions go on without end."""
    x = n.cast("double")
    one = lambda by, sign: F.format_string(f"%.1f{sign}", F.rint(x / by * 10) / 10)
    shown = F.when(x < 1e3, F.format_string("%.0f", x)).when(x < 1e6, one(1e3, "k"))
    return shown.otherwise(one(1e6, "M")) if most == "M" else shown.when(x < 1e9, one(1e6, "M")).otherwise(one(1e9, "B"))


def separated(n: Column) -> Column:
    """Thousands separated by commas."""
    return F.format_number(n, 0)


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(separated(n), F.lit(" "), F.when(n == 1, one).otherwise(many))


def percent(share: Column) -> Column:
    """Whole percent, ties to even; a share that is there but tiny reads ``<1%``."""
    return F.when((share > 0) & (share < 0.005), "<1%").otherwise(F.concat(F.rint(share * 100).cast("long").cast("string"), F.lit("%")))


def named_month(c: Column) -> Column:
    """``2024-03`` as ``March 2024``; anything else stays."""
    date = F.when(c.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd"))
    return F.coalesce(F.date_format(date, "MMMM yyyy"), c)


def display_model(c: Column) -> Column:
    return F.when(c.isin(*NO_MODEL_SPELLINGS), NO_MODEL).otherwise(c)


def label(**dims: Column) -> Column:
    """Dimension values of a row, joined for display."""
    shown = {"month": named_month, "model": display_model}
    return F.concat_ws(" · ", *[shown.get(name, lambda c: c)(c) for name, c in dims.items()])


def spark_line(values: Column) -> Column:
    """An array of numbers as bars of eight heights."""
    top = F.array_max(values)
    glyphs = F.array(*map(F.lit, _GLYPHS))
    bar = lambda v: F.get(glyphs, F.when(top > 0, F.least(F.floor(v / top * 7), F.lit(7))).otherwise(0).cast("int"))
    return F.array_join(F.transform(values, bar), "")


# Lines of a patch that are neither content nor a hunk's head.
_PATCH_META = (
    "+++", "---", "diff --git", "index ", "old mode ", "new mode ", "new file mode ", "deleted file mode ",
    "similarity index ", "dissimilarity index ", "rename from ", "rename to ", "copy from ", "copy to ",
    "Binary files ", "GIT binary patch", "\\ No newline at end of file",
)


def diff_line_kind(line: Column) -> Column:
    """The part of a patch that a line belongs to; file heads come before bare signs."""
    meta = F.lit(False)
    for sign in _PATCH_META:
        meta = meta | line.startswith(sign)
    return (
        F.when(line.startswith("@@"), "hunk")
        .when(meta, "meta")
        .when(line.startswith("+"), "added")
        .when(line.startswith("-"), "removed")
        .otherwise("context")
    )


def clipped_line(line: Column, most: int = 2000) -> Column:
    """A patch line for display: tabs widened, unsafe characters replaced, long lines cut."""
    shown = safe_text(F.regexp_replace(F.regexp_replace(line, r"[\r\n]+$", ""), "\t", "    "))
    return F.when(F.length(shown) <= most, shown).otherwise(F.concat(F.substring(shown, 1, most), F.lit("…")))
