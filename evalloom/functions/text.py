"""Functions on paths, URLs and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a text that a judge is shown.
MAX_CHARS = 6000


def strip(c: Column) -> Column:
    """White space of any script removed at both ends, the four separators of ASCII included."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def normalise_path(c: Column) -> Column:
    """Stripped, forward slashes, without one leading ``corpus/``, each ``.aspx.txt`` as ``.txt``."""
    slashes = F.replace(strip(c), F.lit("\\"), F.lit("/"))
    return F.replace(F.regexp_replace(slashes, r"^corpus/", ""), F.lit(".aspx.txt"), F.lit(".txt"))


def truncate(c: Column, size: int = MAX_CHARS) -> Column:
    """C2."""
    return F.substring(c, 1, size)


def suffix(path: Column) -> Column:
    """The last dot of the base name and what follows, in lower case; none for a name that only begins or ends with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^\.*[^.].*?(\.[^.]+)$", 1))


def component(path: Column, n: int) -> Column:
    """C4: the n-th part of a path (1-based), empty where there is none."""
    return F.split_part(path, F.lit("/"), F.lit(n))


def base_name(path: Column) -> Column:
    """C5."""
    return F.element_at(F.split(path, "/"), -1)


def cited_kind(path: Column) -> Column:
    """``pdf`` by a suffix in lower case, else ``txt``."""
    return F.when(F.endswith(path, F.lit(".pdf")), "pdf").otherwise("txt")


def kind(path: Column) -> Column:
    """``pdf``, ``txt`` or ``other``, by the suffix in any case."""
    return F.when(suffix(path) == ".pdf", "pdf").when(suffix(path) == ".txt", "txt").otherwise("other")


def first_class(c: Column, classes: list[tuple[str, str]], default: str) -> Column:
    """The label of the first part that a text contains, in the order given."""
    out = None
    for needle, label in classes:
        hit = F.contains(c, F.lit(needle))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def chars(c: Column) -> Column:
    """Code points."""
    return F.length(c).cast("bigint")


def preset_of_label(label: Column) -> Column:
    """The preset that a run's label tells, or null."""
    low = F.lower(label)
    has = lambda x: F.contains(low, F.lit(x))
    return F.when(has("baseline"), "baseline").when(has("no cite") | has("no-cite"), "no-cite").when(has("concise"), "concise").when(has("few-shot") | has("few shot"), "default")


def resolve_preset(explicit: Column, of_log: Column, label: Column) -> Column:
    """C11: the first of these that tells one, else ``baseline``; empty texts tell none."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(of_log, F.lit("")), preset_of_label(label), F.lit("baseline"))


def with_sources(answer: Column, citations: Column, heading: str, page_word: str) -> Column:
    """An answer followed by a list of its sources; unchanged without any."""
    line = F.transform(citations, lambda c: F.concat(F.lit("- "), c["file"], F.when(c["page"].isNotNull(), F.concat(F.lit(f", {page_word} "), c["page"].cast("string"))).otherwise("")))
    return F.when(F.coalesce(F.size(citations), F.lit(0)) == 0, answer).otherwise(F.concat(answer, F.lit(f"\n\n{heading}\n"), F.array_join(line, "\n")))


def source_blocks(resolved: Column) -> Column:
    """Texts of resolved citations under numbered heads; pages null or 0 aren't named."""
    page = lambda r: F.when(F.coalesce(r["page"], F.lit(0)) != 0, F.concat(F.lit(" (page "), r["page"].cast("string"), F.lit(")"))).otherwise("")
    return F.array_join(F.transform(resolved, lambda r, i: F.concat(F.lit("--- Citation "), (i + 1).cast("string"), F.lit(": "), r["file"], page(r), F.lit(" ---\n"), F.coalesce(r["text"], F.lit("")))), "\n\n")


def fill(template: str, **values: Column) -> Column:
    """C14: a template with ``{name}`` places; values are put in as they are, braces in them included."""
    parts, rest = [], template
    while rest:
        hits = [(p, k) for k in values if (p := rest.find("{" + k + "}")) >= 0]
        if not hits:
            break
        p, k = min(hits)
        parts += [F.lit(rest[:p]), values[k]]
        rest = rest[p + len(k) + 2 :]
    return F.concat(*parts, F.lit(rest))


def shown_answer(answer: Column) -> Column:
    """A placeholder for null and empty answers."""
    return F.coalesce(F.nullif(answer, F.lit("")), F.lit("(empty answer)"))


def escape_html(c: Column, quotes: bool = True) -> Column:
    """Ampersand and angle brackets, and quotes if asked for; null is empty."""
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def title(c: Column) -> Column:
    """C20: each row of letters with a capital first, whatever stands before it."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def count_matches(c: Column, pattern: str) -> Column:
    """C24, C25."""
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


#: Hebrew and Latin letters.
HEBREW, LATIN = r"[֐-׿]", "[A-Za-z]"


def script_ratio(c: Column, pattern: str = HEBREW, other: str = LATIN) -> Column:
    """Letters of one script among those of two and one more, so that texts without letters have 0."""
    a, b = count_matches(c, pattern), count_matches(c, other)
    return a.cast("double") / (a + b + 1).cast("double")


def has_digit(c: Column) -> Column:
    """A decimal digit of any script."""
    return c.rlike(r"\p{Nd}")


def contains_any_case(c: Column, part: str) -> Column:
    """F13."""
    return F.contains(F.lower(c), F.lower(F.lit(part)))
