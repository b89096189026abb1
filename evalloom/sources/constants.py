"""Small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels of domain codes; a code without one is its own label.
DOMAIN_LABELS = {
    "apartment": "Apartment",
    "business": "Business",
    "car": "Car",
    "dental": "Dental",
    "diseases-disabilities": "Diseases & Disabilities",
    "health": "Health",
    "life": "Life",
    "long-term-care": "Long-Term Care",
    "loss-of-working-ability": "Loss of Working Ability",
    "mortgage": "Mortgage",
    "personal-accident": "Personal Accident",
    "travel": "Travel",
}
#: Parts of file names and the class that each stands for.
KEYWORDS = {
    "פוליס": "Policy (פוליס)",
    "תנאי": "Terms (תנאי)",
    "טופס": "Form (טופס)",
    "חוברת": "Booklet (חוברת)",
    "הודעה": "Notice (הודעה)",
    "מידע": "Material info (מידע)",
    "נוהל": "Procedure (נוהל)",
    "תצהיר": "Affidavit (תצהיר)",
    "כתב": "Deed/charter (כתב)",
}
#: Difficulties in their own order, and what each verdict on citations is worth.
DIFFICULTIES = ("easy", "medium", "hard")
ESTABLISHES = {"fully": 1.0, "partially": 0.5, "not_at_all": 0.0}
#: US dollars per million prompt and completion tokens.
PRICES = (0.5, 2.0)
#: Presets, and the heading and page word of cited sources.
PRESETS = ("default", "concise", "no-cite")
SOURCES_HEADING, PAGE_WORD = "מקורות:", "עמוד"


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def lookup(column: Column | str, entries: dict, default: Column | None = None) -> Column:
    """Value of a key in a small fixed map, else ``default``, else the key itself."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.try_element_at(literal_map(entries), c), c if default is None else default)


def keyword_table(spark: SparkSession, keywords: dict[str, str] = KEYWORDS) -> DataFrame:
    """``needle, label, needle_pos``; a handful of rows."""
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(keywords.items())], "needle string, label string, needle_pos int")
