"""Text functions as Column expressions: tokens, sections, dates, degrees, contacts, redaction, sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of the repetition signal.
STOPWORDS = frozenset(
    "the and for with from that this have has had was were are is be been being our your their his her its not but all any can will would should could may into over under more most other such than then them they you i a an of to in on at by as it or if we us me my he she do does did done using used use work working worked experience team teams project projects role roles year years including include includes across within also new via per etc".split()
)

#: Section -> headings that open it.
SECTION_HEADINGS: dict[str, tuple[str, ...]] = {
    "summary": ("summary", "objective", "profile", "about me", "professional summary", "career overview", "professional overview", "highlights", "core qualifications", "career focus"),
    "experience": ("experience", "work experience", "professional experience", "employment", "employment history", "work history", "career history", "professional background", "accomplishments", "experience highlights"),
    "education": ("education", "academic background", "academics", "qualifications", "education and training", "educational background"),
    "skills": ("skills", "technical skills", "core skills", "technologies", "technical proficiencies", "competencies", "tech stack", "skill highlights", "areas of expertise", "key skills", "technical expertise"),
    "projects": ("projects", "personal projects", "selected projects", "portfolio"),
    "certifications": ("certifications", "certificates", "licenses", "courses", "training"),
}
_HEADING_WORDS = 5

#: Patterns of dates, degrees, contacts and requirement markers.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}
_MONTH = "|".join(MONTHS)
_DATE = rf"(?:(?:{_MONTH})[a-z]*\.?\s*,?\s*\d{{4}}|\d{{1,2}}[/-]\d{{4}}|\d{{4}})"
_PRESENT = r"(?:present|current|currently|now|ongoing|to\s*date|till\s*date)"
_TO = r"\s*(?:-|–|—|to|until|through)\s*"
RANGE = rf"(?i)({_DATE}){_TO}({_DATE}|{_PRESENT})"
CLAIMED_YEARS = r"(?i)(\d{1,2}(?:\.\d)?)\s*\+?\s*(?:years?|yrs?)\s*(?:of\s*)?(?:professional\s*|work\s*|industry\s*|relevant\s*)?experience"
MIN_YEARS = r"(?i)(?:at\s+least\s+|minimum\s+(?:of\s+)?|min\.?\s+)?(\d{1,2})\s*\+?\s*(?:-\s*\d{1,2}\s*)?(?:years?|yrs?)"
JOB_LINE = rf"(?im)^([^\n,|]{{3,60}}?)\s*(?:[,|@]|\bat\b|–|-)\s*([^\n,|]{{2,60}}?)\s*[,|]?\s*({_DATE}{_TO}(?:{_DATE}|{_PRESENT}))"
DEGREES = (
    (4, r"(?i)\b(ph\.?\s?d|doctorate|doctoral|d\.?phil)\b"),
    (3, r"(?i)\b(m\.?\s?tech|m\.?\s?sc|msc|m\.?\s?s\b|master['’]?s?|m\.?\s?b\.?\s?a|mba|m\.?\s?c\.?\s?a|m\.?\s?e\b)\b"),
    (2, r"(?i)\b(b\.?\s?tech|b\.?\s?sc|bsc|b\.?\s?s\b|bachelor['’]?s?|b\.?\s?e\b|b\.?\s?c\.?\s?a|b\.?\s?com)\b"),
    (1, r"(?i)\b(associate['’]?s?\s+degree|diploma|foundation\s+degree)\b"),
)
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"(?:\+\d{1,3}[\s-]?)?(?:\(\d{2,4}\)[\s-]?)?\d{3,5}[\s-]?\d{3,4}[\s-]?\d{0,4}"
REDACT_PHONE = r"(?:\+\d{1,3}[\s-]?)?(?:\(\d{3}\)[\s-]?)?\d{3}[\s-]?\d{4}\b"
URL = r"https?://\S+|www\.\S+"
PREFERRED = r"(?i)\b(preferred|nice[\s-]to[\s-]have|bonus|plus|desirable|advantageous|good[\s-]to[\s-]have|optional)\b"
SENTENCE = r"(?<=[.!?])\s+|\n+|\s*[•·]\s*"
_SENTENCE_CHARS = 12
_LINE = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85" + "".join(map(chr, (0x2028, 0x2029))) + "]"
_OPEN, _CLOSE = "\x01", "\x02"  # mark headings between lines; control characters that no text keeps


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A lambda that names an outer expression computes it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalise(surface: Column) -> Column:
    """Lower case, white space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(surface), r"\s+", " "))


def tidy(text: Column) -> Column:
    """Blanks before line ends and runs of empty lines go."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def lines(text: Column) -> Column:
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return let(F.split(text_or_empty(text), _LINE), whole)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def tokens(text: Column) -> Column:
    """Lower-case words of two characters or more; inner and final ``+``, ``#``, ``.`` belong to them."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"[a-z][a-z+#.]{1,}"), F.lit(0))


def rank_tokens(text: Column) -> Column:
    """Words as the lexical rankers see them."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"[a-z0-9][a-z0-9+#.\-]*"), F.lit(0))


def trigrams(words: Column) -> Column:
    """Distinct runs of three words."""
    return F.array_distinct(ngrams(words, 3))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by blanks: the array zipped with itself moved on, in linear time."""

    def runs(w: Column) -> Column:
        out = w
        for k in range(1, n):
            moved = F.slice(w, F.lit(k + 1), F.greatest(F.size(w) - k, F.lit(0)))
            out = F.zip_with(out, moved, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.filter(out, lambda x: x.isNotNull())

    return let(words, runs)


def normalise_headings(text: Column) -> Column:
    """Headings that stand inside a line, between runs of blanks, get a line of their own."""
    names = sorted({h for hs in SECTION_HEADINGS.values() for h in hs}, key=lambda h: (-len(h), h))
    return F.regexp_replace(text_or_empty(text), rf"(?i)(?:(?<=\n)|(?<=\s{{3}})|^)\s*({'|'.join(names)})(?=\s{{2,}}|\s*:|\n|$)", "\n$1\n")


_OPENS = r"^[^a-z]*+(?:" + "|".join(h.replace(" ", "[^a-z]+") for hs in SECTION_HEADINGS.values() for h in hs) + r")[^a-z]*+\z"


def heading_of(line: Column) -> Column:
    """The section that a line opens, or null. Most lines open none: one pattern tells, before anything is cut or counted."""
    bare = strip(F.regexp_replace(strip(line), r"^:+|:+$", ""))
    folded = F.trim(F.regexp_replace(F.lower(line), "[^a-z]+", " "))
    known = F.create_map(*[F.lit(x) for s, hs in SECTION_HEADINGS.items() for h in hs for x in (h, s)])
    return F.when(F.lower(line).rlike(_OPENS), F.when(word_count(bare) <= _HEADING_WORDS, F.try_element_at(known, folded)))


def segment_sections(text: Column) -> Column:
    """Map of section -> body. Lines before the first heading are ``other``; a section that occurs twice is joined.

    One pass: heading lines become marks, the marked text is split at them, and each section collects its parts.
    """
    rows = lines(normalise_headings(F.translate(text_or_empty(text), _OPEN + _CLOSE, "")))
    marked = F.array_join(F.transform(rows, lambda x: F.coalesce(F.concat(F.lit(_OPEN), heading_of(x), F.lit(_CLOSE)), x)), "\n")
    # An empty text has no lines and no sections.
    first = let(marked, lambda m: F.when(F.startswith(m, F.lit(_OPEN)) | (m == ""), m).otherwise(F.concat(F.lit(f"{_OPEN}other{_CLOSE}\n"), m)))
    parts = F.filter(F.split(first, _OPEN), lambda p: p != "")
    cut = lambda p: F.struct(F.substring_index(p, _CLOSE, 1).alias("name"), F.regexp_replace(F.regexp_replace(F.substring_index(p, _CLOSE, -1), r"^\n", ""), r"\n\z", "").alias("body"))

    def collect(bodies: Column) -> Column:
        names = F.array_distinct(F.transform(bodies, lambda b: b.getField("name")))
        joined = F.transform(names, lambda n: strip(F.array_join(F.transform(F.filter(bodies, lambda b: b.getField("name") == n), lambda b: b.getField("body")), "\n")))
        return F.map_from_arrays(names, joined)

    return let(F.transform(parts, cut), collect)


def month_index(token: Column, default_month: int, as_of: Column) -> Column:
    """A date token as year * 12 + month; the present is ``as_of``; null for anything else."""
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    named, numbered = rf"^({_MONTH})[a-z]*\.?\s*(\d{{4}})$", r"^(\d{1,2})[/-](\d{4})$"

    def index(t: Column) -> Column:
        number = lambda pattern, group: F.regexp_extract(t, pattern, group).try_cast("int")
        return (
            F.when(t.rlike(f"^{_PRESENT}$"), as_of)
            .when(t.rlike(named), number(named, 2) * 12 + F.try_element_at(months, F.regexp_extract(t, named, 1)))
            .when(t.rlike(numbered), number(numbered, 2) * 12 + F.least(F.greatest(number(numbered, 1), F.lit(1)), F.lit(12)))
            .when(t.rlike(r"^\d{4}$"), t.try_cast("int") * 12 + default_month)
        )

    return let(F.trim(F.regexp_replace(F.regexp_replace(F.lower(token), ",", " "), r"\s+", " ")), index)


def year_of(index: Column) -> Column:
    return F.floor((index - 1) / F.lit(12)).cast("int")


def month_of(index: Column) -> Column:
    return (F.pmod(index - 1, F.lit(12)) + 1).cast("int")


def merged_months(intervals: Column) -> Column:
    """Months covered by an array of struct(start, end), both inclusive; overlaps count once."""
    start = F.struct(F.lit(0).alias("total"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    span = lambda a: F.coalesce(a.getField("high") - a.getField("low") + 1, F.lit(0))

    def add(acc: Column, x: Column) -> Column:
        s, e = x.getField("start"), x.getField("end")
        grown = F.struct(acc.getField("total").alias("total"), acc.getField("low").alias("low"), F.greatest(acc.getField("high"), e).alias("high"))
        fresh = F.struct((acc.getField("total") + span(acc)).alias("total"), s.alias("low"), e.alias("high"))
        return F.when(s <= acc.getField("high"), grown).otherwise(fresh)

    return F.aggregate(F.array_sort(intervals), start, add, lambda a: a.getField("total") + span(a))


def _until(end: Column, as_of: Column) -> Column:
    return F.when(end > as_of, as_of).otherwise(end)


def experience_years(text: Column, as_of: Column) -> Column:
    """Years covered by the text's date ranges; without any, the years that it claims; else 0."""
    body = text_or_empty(text)
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(RANGE), F.lit(1)).alias("s"), F.regexp_extract_all(body, F.lit(RANGE), F.lit(2)).alias("e"))
    spans = F.transform(pairs, lambda p: F.struct(month_index(p.getField("s"), 1, as_of).cast("int").alias("start"), _until(month_index(p.getField("e"), 12, as_of), as_of).cast("int").alias("end")))
    spans = F.filter(spans, lambda x: x.getField("start").isNotNull() & x.getField("end").isNotNull() & (x.getField("end") >= x.getField("start")))
    claimed = F.coalesce(F.regexp_extract(body, CLAIMED_YEARS, 1).try_cast("double"), F.lit(0.0))
    dated = let(spans, lambda s: F.when(F.size(s) > 0, F.round(merged_months(s) / F.lit(12.0), 2)))
    return F.coalesce(dated, claimed)


def experience_entries(text: Column, as_of: Column) -> Column:
    """Employment rows of "Title at Organisation, dates" lines."""
    body = text_or_empty(text)

    def parts(w: Column) -> Column:
        # A match by itself matches as it did in the text: groups are taken from it, the text is searched once.
        return F.struct(*[F.regexp_extract(w, JOB_LINE, n).alias(k) for n, k in enumerate("wtod")])

    def dated(r: Column) -> Column:
        ends = F.struct(F.regexp_extract(r.getField("d"), RANGE, 1).alias("first"), F.regexp_extract(r.getField("d"), RANGE, 2).alias("last"))
        return let(ends, lambda e: F.struct(month_index(e.getField("first"), 1, as_of).alias("start"), month_index(e.getField("last"), 12, as_of).alias("end"), e.getField("last").alias("last")))

    def entry(r: Column) -> Column:
        return let(dated(r), lambda e: F.struct(
            strip(r.getField("t")).alias("title"), strip(r.getField("o")).alias("organisation"), year_of(e.getField("start")).alias("start_year"), month_of(e.getField("start")).alias("start_month"),
            year_of(e.getField("end")).alias("end_year"), month_of(e.getField("end")).alias("end_month"), F.lower(F.trim(e.getField("last"))).rlike(f"^{_PRESENT}$").alias("is_current"), strip(r.getField("w")).alias("text"),
        ))

    return F.transform(F.transform(F.regexp_extract_all(body, F.lit(JOB_LINE), F.lit(0)), parts), entry)


def degree(text: Column) -> Column:
    """The highest degree tier named, 0 to 4."""
    found = F.lit(0)
    for tier, pattern in reversed(DEGREES):
        found = F.when(text_or_empty(text).rlike(pattern), tier).otherwise(found)
    return found


def email(text: Column) -> Column:
    return F.regexp_extract(text_or_empty(text), f"(?U){EMAIL}", 0)


def phone(text: Column) -> Column:
    """From the first 15 lines, the first with a number of 9 digits or more and no date range."""
    head = F.filter(F.slice(lines(text), 1, 15), lambda x: ~x.rlike(RANGE))
    found = F.filter(F.transform(head, lambda x: F.regexp_extract(x, PHONE, 0)), lambda p: F.length(F.regexp_replace(p, r"\D", "")) >= 9)
    return F.coalesce(strip(F.get(found, F.lit(0))), F.lit(""))


def person_name(text: Column) -> Column:
    """From the first four lines, the first of two to four capitalised words without digits or an address."""
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    capital = lambda x: F.forall(words(x), lambda w: (F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1)) & (F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1)))
    fit = lambda x: (F.size(words(x)).between(2, 4)) & ~x.rlike(EMAIL) & ~x.rlike(r"\d") & capital(x)
    return F.coalesce(F.get(F.filter(F.transform(F.slice(lines(text), 1, 4), strip), fit), F.lit(0)), F.lit(""))


def redact(text: Column) -> Column:
    """Addresses, links and numbers to placeholders, in that order."""
    masked = F.regexp_replace(text, f"(?U){EMAIL}", "[EMAIL]")
    return F.regexp_replace(F.regexp_replace(masked, URL, "[URL]"), REDACT_PHONE, "[PHONE]")


def split_required_preferred(text: Column) -> Column:
    """struct(required, preferred): cut at the first short line with a "preferred" marker."""
    marked = lambda rows: F.array_min(F.transform(rows, lambda x, i: F.when((strip(x) != "") & (word_count(strip(x)) <= 8) & strip(x).rlike(PREFERRED), i)))

    def cut(found: Column) -> Column:
        rows, at = found.getField("rows"), found.getField("at")
        start = F.coalesce(at, F.lit(0))
        before, after = F.array_join(F.slice(rows, F.lit(1), start), "\n"), F.array_join(F.slice(rows, start + 1, F.size(rows) + 1), "\n")
        return F.struct(F.when(at.isNull(), text_or_empty(text)).otherwise(before).alias("required"), F.when(at.isNull(), "").otherwise(after).alias("preferred"))

    return let(let(lines(text), lambda rows: F.struct(rows.alias("rows"), marked(rows).alias("at"))), cut)


def sentences(text: Column) -> Column:
    """Sentences of 12 characters or more, without bullets and dashes around them."""
    parts = F.transform(F.split(text_or_empty(text), SENTENCE), lambda s: F.regexp_replace(s, r"^[ \t–—*-]+|[ \t–—*-]+$", ""))
    return F.filter(parts, lambda s: F.length(s) >= _SENTENCE_CHARS)


def narrative(sections: Column, text: Column) -> Column:
    """The text that can show skills: experience and projects, else summary, certifications and other, else all."""
    from rankweave.schemas import section

    joined = lambda *names: strip(F.concat_ws("\n", *[section(sections, n) for n in names]))
    filled = lambda value: let(value, lambda v: F.when(v != "", v))
    return F.coalesce(filled(joined("experience", "projects")), filled(joined("summary", "certifications", "other")), text_or_empty(text))
