"""Row types, and the accessors on them as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from enum import IntEnum, StrEnum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = 0xFFFFFF


class DegreeLevel(IntEnum):
    NONE = 0
    ASSOCIATE = 1
    BACHELOR = 2
    MASTER = 3
    DOCTORATE = 4

    @property
    def label(self) -> str:
        return DEGREE_LABELS[self.value]


class GapStatus(StrEnum):
    MATCHED = "matched"
    TRANSFERABLE = "transferable"
    MISSING = "missing"


#: What is shown for each tier.
DEGREE_LABELS = ("None detected", "Associate", "Bachelor's", "Master's", "Doctorate")

def _row(**kinds: T.DataType | str) -> T.StructType:
    simple = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(name, simple[kind] if isinstance(kind, str) else kind) for name, kind in kinds.items()])


_STRINGS = T.ArrayType(T.StringType())
SPAN = _row(text="string", page="int", font="string", size="double", color="int", flags="int", bbox=T.ArrayType(T.DoubleType()))
DOCUMENT = _row(path="string", text="string", source_format="string", spans=T.ArrayType(SPAN), page_count="int", page_backgrounds=T.ArrayType(T.IntegerType()))
ENTRY = _row(title="string", organisation="string", start_year="int", start_month="int", end_year="int", end_month="int", is_current="boolean", text="string")
RESUME = _row(
    candidate_id="string", name="string", email="string", phone="string", sections=T.MapType(T.StringType(), T.StringType()), skills=_STRINGS, skills_expanded=_STRINGS,
    years_experience="double", degree="int", experience_entries=T.ArrayType(ENTRY),
)
JOB = _row(job_id="string", title="string", text="string", required=_STRINGS, preferred=_STRINGS, min_years="double", min_degree="int")
SUB_SCORES = _row(semantic="double", skill="double", experience="double", education="double", penalty="double", total="double", gate="double", required_coverage="double")
SIGNAL = _row(name="string", triggered="boolean", severity="double", evidence="string")


def degree_label(degree: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in DEGREE_LABELS]), F.coalesce(degree, F.lit(0)) + 1)


def rgb(color: Column) -> Column:
    """Packed 0xRRGGBB -> struct(r, g, b), null where the colour is unknown (negative or null)."""
    part = lambda shift: F.shiftright(color, shift).bitwiseAND(F.lit(255)).cast("int")
    return F.when(color >= 0, F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b")))


def background_for(backgrounds: Column, page: Column) -> Column:
    """A page's background, white where it isn't known."""
    return F.coalesce(F.when(page >= 0, F.get(backgrounds, page)), F.lit(WHITE))


def section(sections: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(sections, F.lit(name)), F.lit(""))


def has_dates(entry: Column) -> Column:
    return entry.getField("start_year").isNotNull()


def all_skills(required: Column, preferred: Column) -> Column:
    return F.array_union(required, preferred)


def display_name(name: Column, candidate_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), candidate_id)


def triggered_signals(signals: Column) -> Column:
    return F.filter(signals, lambda s: s.getField("triggered"))


def signal(signals: Column, name: str) -> Column:
    """The first signal of that name, null if there is none."""
    return F.get(F.filter(signals, lambda s: s.getField("name") == name), F.lit(0))


def summarise_skills(skills: Column, limit: int = 8) -> Column:
    """Sorted and comma-joined, cut after ``limit`` with the number left out."""
    ordered = F.sort_array(skills)
    more = F.size(skills) - limit
    shown = F.array_join(F.slice(ordered, 1, limit), ", ")
    return F.when(more > 0, F.concat(shown, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(shown)


def summarise(skills: Iterable[str], limit: int = 8) -> str:
    """The same for a Python collection."""
    ordered = sorted(skills)
    return ", ".join(ordered[:limit]) + (f" (+{len(ordered) - limit} more)" if len(ordered) > limit else "")
