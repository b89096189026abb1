"""Benchmark decontamination: templates with typed placeholders, windows joined by hash, slots checked for consistency.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_lookup, materialize, with_partner

#: Tokens of a window, and how many of them must be plain words.
WINDOW, WORDS = 8, 4
#: Share of a benchmark item's windows that a document has to hold.
COVERAGE = 0.5
#: Tables of up to this many rows are broadcast (under 100 bytes a row); larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000

NUMBER, NAME, UNIT = "‹num›", "‹name›", "‹unit›"
#: Holds the words of a name together where values are kept.
GLUE = "¤"
#: Units that may follow a number.
UNITS = (
    "mm cm dm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "kb mb gb tb hz khz mhz ghz w kw v a j kj cal kcal percent degree degrees dollar dollars cent cents euro euros eur usd gbp"
)

#: Words that often begin a sentence and are no names, in the languages of the corpus.
STARTERS = (
    "a after all an and any as at because before but by each every first for from given he her here his how i if in is it its last let most my no not now of on once one or our she so some "
    "such that the their then there these they this those to two we what when where which while who why with you your "
    "das dem den der des die ein eine einem einen einer er es für ihr im ist mit nach sie und vom von war was wenn wer wie wir zu zum zur "
    "al cada como con cuando de del el ella en entre ese esta este la las le les lo los más me mi nos para pero por que se si sin su sus un una y ya "
    "au aux avec c ce ces cette chaque dans du elle est et ils je leur mais ne nous ou par pas plus pour quand qui sa ses son sur tous tout une vous"
)

_NUMBERS = r"(?<![\p{L}\p{N}])[\p{Sc}]?\p{N}[\p{N}.,:/]*(?:(?<=\p{N})(?:%|°|\p{L}{1,3}(?!\p{L})))?"
_UNITS = rf"(?i)(?<={NUMBER}\s)(?:{'|'.join(sorted(UNITS.split(), key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"
# the rare letter comes first and what stands before it is looked at afterwards, so most places are passed at one glance
_IN_NAME = r"[\p{L}\p{M}\p{N}'’-]"
_STARTS: dict[str, list[str]] = {}
for _w in sorted(set(STARTERS.split())):
    _STARTS.setdefault(_w[0].upper(), []).append(_w[1:])
_NO_STARTER = "(?!(?:" + "|".join(f"(?<={c})(?:{'|'.join(rest)})" for c, rest in _STARTS.items()) + f")(?!{_IN_NAME}))"
_CAPITAL = rf"\p{{Lu}}{_NO_STARTER}"
_BEFORE = r"(?<![\p{L}\p{M}\p{N}'’-].)"
_NAMES = rf"\p{{Lu}}{_BEFORE}{_NO_STARTER}{_IN_NAME}*+(?:\s++{_CAPITAL}{_IN_NAME}*+)*+"
_PUNCTUATION = r"""[.,;:!?"'()\[\]]"""


def _spaced(text: Column) -> Column:
    """Lower case, no punctuation, one space between tokens, none at the ends. Simple patterns one after the other are faster
    than one that does it all."""
    plain = F.regexp_replace(F.lower(text), _PUNCTUATION + "+", "")
    spaced = F.trim(F.regexp_replace(plain, r"[\n\t\r\x0b\f]", " "))
    return F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced)


def templates(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``_named`` and ``_words``: ``text`` as a template, tokens with one space between them, once with names typed
    and once with names as words like others.

    Digits, with currency sign, percent or a short unit attached, are a number; a unit's word after a number is a unit; a row
    of capitalised words, wherever it stands in its sentence, is one name, but for ``STARTERS``. All else is lower-cased and loses its
    punctuation; tokens of punctuation alone are none. Null, empty and blank texts have an empty template.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    counted = F.regexp_replace(F.regexp_replace(plain, _NUMBERS, NUMBER), _UNITS, UNIT)
    out = df.withColumn("_typed", F.when(plain.rlike(r"\p{N}"), counted).otherwise(plain))
    return out.withColumn("_named", _spaced(F.regexp_replace("_typed", _NAMES, NAME))).withColumn("_words", _spaced(F.col("_typed"))).drop("_typed")


def values(text: Column) -> Column:
    """``_named`` with values: each placeholder has what it stands for before it, names held together by ``GLUE``."""
    typed = F.regexp_replace(F.regexp_replace(text, _NUMBERS, f"$0{NUMBER}"), _UNITS, f"$0{UNIT}")
    glued = F.regexp_replace(typed, rf"(\p{{Lu}}{_BEFORE}{_NO_STARTER}{_IN_NAME}*+)\s++(?={_CAPITAL})", f"$1{GLUE}")
    return _spaced(F.regexp_replace(glued, rf"\p{{Lu}}{_BEFORE}{_NO_STARTER}[\p{{L}}\p{{M}}\p{{N}}'’{GLUE}-]*+(?!‹)", f"$0{NAME}"))


def word_values(text: Column) -> Column:
    """As ``values``, for ``_words``."""
    return _spaced(F.regexp_replace(F.regexp_replace(text, _NUMBERS, f"$0{NUMBER}"), _UNITS, f"$0{UNIT}"))


def _tokens(form: Column) -> Column:
    return F.when(form != "", F.split(form, " ")).otherwise(F.array().cast("array<string>"))


def _is_slot(token: Column) -> Column:
    return F.contains(token, F.lit("‹"))


def _step(size: Column) -> Column:
    """Blocks of so many tokens, one after the other, are taken from documents: any window of ``size`` tokens holds a whole one."""
    return F.when(size >= 7, 4).otherwise(2)


def _blocks(form: str, step: int) -> Column:
    """Whole blocks of ``step`` tokens, the first at the first token."""
    return F.regexp_extract_all(form, F.lit("[^ ]++" + " [^ ]++" * (step - 1)), F.lit(0))


def benchmark_forms(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """A row for each form of each different template: ``fid`` (64 bits that stand for it), ``item_id`` (the least with that
    template), ``item_ids`` (all), ``worded``, the tokens ``i_tok`` and their values ``i_val``, the ``size`` of its windows and
    where they ``start``.

    Capitals tell names only where a text has them as usual, so items with names have a second form for each different
    wording, with names as words (``worded``). Items of fewer than ``WINDOW`` tokens are one window. Windows with fewer than
    ``WORDS`` plain words would fit anything and are left out, so items without any other are never found; null and empty
    items neither. Null keys are left out.
    """
    both = templates(items.where(F.col(key).isNotNull()).select(F.col(key).alias("_item"), F.coalesce(F.col(text), F.lit("")).alias("_t")), "_t")
    named = both.groupBy("_named").agg(F.min("_item").alias("item_id"), F.array_sort(F.collect_set("_item")).alias("item_ids"), F.min_by("_t", F.struct("_item", "_t")).alias("_t"))
    worded = both.where(F.contains("_named", F.lit(NAME))).groupBy("_named", "_words").agg(F.min_by("_t", F.struct("_item", "_t")).alias("_t"))
    worded = worded.join(named.drop("_t"), "_named").select("item_id", "item_ids", F.lit(True).alias("worded"), _tokens(F.col("_words")).alias("i_tok"), _tokens(word_values(F.col("_t"))).alias("i_val"))
    forms = named.select("item_id", "item_ids", F.lit(False).alias("worded"), _tokens(F.col("_named")).alias("i_tok"), _tokens(values(F.col("_t"))).alias("i_val")).unionByName(worded)
    forms = forms.withColumn("size", F.least(F.size("i_tok"), F.lit(WINDOW))).where(F.size("i_tok") >= WORDS)
    starts = F.sequence(F.lit(0), F.size("i_tok") - F.col("size"))
    full = F.filter(starts, lambda q: F.size(F.filter(F.slice("i_tok", q + 1, F.col("size")), lambda w: ~_is_slot(w))) >= WORDS)
    forms = forms.withColumn("starts", full).where(F.size("starts") > 0)
    return forms.withColumn("fid", F.xxhash64("item_id", "worded", "i_tok"))


def _block_index(forms: DataFrame) -> DataFrame:
    """``hash, at``: for each block of the forms' windows, wherever it begins, the forms and places that have it."""
    step = _step(F.col("size"))
    places = forms.withColumn("q", F.explode(F.sequence(F.lit(0), F.size("i_tok") - step)))
    inside = F.exists("starts", lambda s: (s <= F.col("q")) & (F.col("q") + step <= s + F.col("size")))
    block = F.xxhash64(F.array_join(F.slice("i_tok", F.col("q") + 1, step), " "), step.cast("int"))
    return places.where(inside).select(block.alias("hash"), "fid", "q").groupBy("hash").agg(F.collect_set(F.struct("fid", "q")).alias("at"))


def _fits(df: DataFrame, rows: Column, most: int = BROADCAST_ROWS) -> bool:
    """Whether a written table can be broadcast; ``rows`` counts what one of its rows holds."""
    return (df.agg(F.sum(rows)).first()[0] or 0) <= most


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: written in place, it would be computed anew for every element of a loop."""
    return F.transform(F.array(value), body)[0]


def _run(equal: Column) -> Column:
    """How many elements are true before the first that isn't."""
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(equal)).otherwise(first.cast("int") - 1)


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", coverage: float = COVERAGE) -> DataFrame:
    """``key, item_id, item_ids, n_windows, coverage, verbatim`` for each document and item that it holds; ``_text`` is the
    hash of the document's text, by which rows with null or equal keys are told apart.

    Of a document's template every fourth window of four tokens (every second of two, for items of under seven tokens) is
    joined by hash with all those of the items: every window of ``WINDOW`` tokens holds one. From there the tokens are compared
    to both sides. Windows at one offset count together, and only if their slots agree: each value of the item stands for one
    value in the document, and the other way round (names word by word where they are equally long, units without a plural's
    s). Offsets are added, from the one with the most windows on, if they agree with those before. A document
    holds an item if it has at least ``coverage`` of its windows; ``verbatim`` says that all values are the same. Texts are
    also read with names as words, so copies in other capitals are found; of an item's two forms the one that covers more
    counts. Items with equal templates are one, and documents without any item have no row; equal rows have one in common.
    Null and empty texts hold nothing.

    The join carries hashes and places only; texts are fetched once more for documents that met an item.
    """
    forms = materialize(benchmark_forms(items, item_text, item_key), "benchmark")
    steps = sorted(r[0] for r in forms.select(_step(F.col("size"))).distinct().collect()) or [4]
    index = materialize(_block_index(forms), "blocks")
    body = docs.select(F.col(key).alias("_key"), F.col(text).alias("_body"))
    base = templates(body, "_body").select(F.xxhash64("_body").alias("_text"), "_named", "_words")
    # one pass over the documents: blocks of all kinds follow each other
    kinds = [(worded, s) for worded in (False, True) for s in steps]
    base = base.select("_text", *[_blocks("_words" if worded else "_named", s).alias(f"_b{k}") for k, (worded, s) in enumerate(kinds)])
    base = base.select("_text", *[F.size(f"_b{k}").alias(f"_n{k}") for k in range(len(kinds))], F.posexplode(F.concat(*[f"_b{k}" for k in range(len(kinds))])).alias("_at", "_block"))
    before, kind, p, step = F.lit(0), F.lit(False), F.col("_at"), F.lit(steps[0])
    for k, (worded, s) in enumerate(kinds):
        here = F.col("_at") >= before
        kind, p, step = F.when(here, F.lit(worded)).otherwise(kind), F.when(here, (F.col("_at") - before) * s).otherwise(p), F.when(here, F.lit(s)).otherwise(step)
        before = before + F.col(f"_n{k}")
    met = base.select("_text", kind.alias("_worded"), p.alias("p"), F.xxhash64("_block", step).alias("_hash"))
    table = F.broadcast(index) if _fits(index, F.size("at")) else index
    met = met.join(table, F.col("_hash") == F.col("hash"))
    # rows with equal texts are one from here on; each block is there once a row
    met = met.groupBy("_text", "_worded", "p", "hash").agg(F.first("at").alias("at"), F.count("*").alias("n"))
    met = met.select("_text", "n", "_worded", "p", F.explode("at").alias("h")).select("_text", "n", F.struct("h.fid", "p", "h.q", F.col("_worded").alias("worded")).alias("hit"))
    met = materialize(met.groupBy("_text").agg(F.collect_set("hit").alias("hits"), F.max("n").alias("n_rows")), "met")

    # texts that met nothing stay where they are
    texts = with_partner(body.withColumn("_text", F.xxhash64("_body")), "_text", met.select("_text")).where("_met").drop("_met")
    rows = met.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    held = hot_lookup(texts, met, "_text", rows, "inner")
    held = templates(held, "_body").withColumn("_named_val", values(F.col("_body"))).withColumn("_words_val", word_values(F.col("_body")))
    readings = F.struct(*[_tokens(F.col(f"_{c}")).alias(c) for c in ("named", "words", "named_val", "words_val")])
    # of each reading only the tokens about a hit go on: no window that holds the block begins or ends further away
    reach = lambda c, h: F.slice(c, F.greatest(h["p"] - WINDOW, F.lit(0)) + 1, 2 * WINDOW)
    near = lambda r: F.transform("hits", lambda h: F.struct(*[h[c].alias(c) for c in ("fid", "p", "q", "worded")], *[reach(r[c], h).alias(c) for c in ("named", "words", "named_val", "words_val")]))
    hits = held.select("_key", "_text", F.explode(_bound(readings, near)).alias("h")).select("_key", "_text", "h.*")
    forms = forms.drop("worded")
    hits = hits.join(F.broadcast(forms) if _fits(forms, F.size("i_tok")) else forms, "fid")
    pick = lambda words, names: F.when(F.col("worded"), F.col(words)).otherwise(F.col(names))
    hits = hits.withColumn("d_tok", pick("words", "named")).withColumn("d_val", pick("words_val", "named_val")).drop("named", "words", "named_val", "words_val")
    hits = hits.withColumn("offset", F.col("p") - F.col("q")).withColumn("p", F.least("p", F.lit(WINDOW)))
    left, right = F.least("p", "q", F.col("size")), F.least(F.size("i_tok") - F.col("q"), F.size("d_tok") - F.col("p"), F.col("size"))

    def around(r: Column) -> Column:
        """How many tokens are the same before the block's begin, and from there on."""
        before = F.zip_with(*[F.reverse(F.slice(c, F.col(at) - r["left"] + 1, r["left"])) for c, at in (("i_tok", "q"), ("d_tok", "p"))], lambda x, y: x == y)
        after = F.zip_with(*[F.slice(c, F.col(at) + 1, r["right"]) for c, at in (("i_tok", "q"), ("d_tok", "p"))], lambda x, y: x == y)
        return F.struct(_bound(before, _run).alias("l"), _bound(after, _run).alias("r"))

    def windows(r: Column) -> Column:
        """Windows of the item that lie within, and the slots there."""
        n = r["l"] + r["r"]
        inside = F.filter("starts", lambda s: (s >= F.col("q") - r["l"]) & (s + F.col("size") <= F.col("q") + r["r"]))
        three = F.arrays_zip(*[F.slice(c, F.col(at) - r["l"] + 1, n).alias(x) for c, at, x in (("i_tok", "q", "t"), ("i_val", "q", "i"), ("d_val", "p", "d"))])
        return F.struct(inside.alias("qs"), F.filter(three, lambda x: _is_slot(x["t"])).alias("slots"))

    hits = hits.withColumn("met", _bound(F.struct(left.alias("left"), right.alias("right")), lambda x: _bound(around(x), windows)))
    hits = hits.select("_key", "_text", "item_id", "item_ids", "worded", "fid", F.size("starts").alias("n_item_windows"), "offset", "met.*").where(F.size("qs") > 0)
    # windows at one offset: as many as the item has at most
    group = ["_key", "_text", "item_id", "item_ids", "fid", "n_item_windows"]
    runs = hits.groupBy(*group, "worded", "offset").agg(F.array_distinct(F.flatten(F.collect_set("qs"))).alias("qs"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    runs = runs.select(*group, "qs", F.explode(F.filter(F.array(_pairs("slots")), _agrees)).alias("slots"))
    runs = runs.groupBy(*group).agg(F.sort_array(F.collect_set(F.struct(F.size("qs").alias("n"), F.array_sort("qs").alias("qs"), F.array_sort("slots").alias("slots"))), asc=False).alias("runs"))

    def add(acc: Column, r: Column) -> Column:
        slots = F.array_union(acc["slots"], r["slots"])
        return F.when(_agrees(slots), F.struct(F.array_union(acc["qs"], r["qs"]).alias("qs"), slots.alias("slots"))).otherwise(acc)

    first = F.struct(F.col("runs")[0]["qs"].alias("qs"), F.col("runs")[0]["slots"].alias("slots"))
    found = runs.withColumn("all", F.aggregate(F.slice("runs", 2, 1 << 30), first, add)).withColumn("n_windows", F.size("all.qs"))
    found = found.withColumn("verbatim", F.forall("all.slots", lambda s: s["i"] == s["d"])).withColumn("coverage", F.col("n_windows").cast("double") / F.col("n_item_windows")).where(F.col("coverage") >= coverage)
    found = found.groupBy("_key", "_text", "item_id", "item_ids").agg(F.max(F.struct("coverage", "n_windows", "verbatim")).alias("best")).select("_key", "_text", "item_id", "item_ids", "best.*")
    return found.select(F.col("_key").alias(key), "item_id", "item_ids", "n_windows", "coverage", "verbatim", "_text")


def _pairs(slots: str) -> Column:
    """(kind, item's value, document's value) of the slots; names of equally many words give a pair for each."""

    def bare(s: Column) -> Column:
        kind = F.regexp_extract(s["t"], "‹([a-z]+)›", 1)
        return F.struct(kind.alias("kind"), *[F.regexp_replace(s[c], "s?‹unit›|‹[a-z]+›", "").alias(c) for c in "id"])

    def each(s: Column) -> Column:
        i, d = F.split(s["i"], GLUE), F.split(s["d"], GLUE)
        return F.when(F.size(i) == F.size(d), F.zip_with(i, d, lambda x, y: F.struct(s["kind"].alias("kind"), x.alias("i"), y.alias("d")))).otherwise(F.array(s))

    return F.array_distinct(F.flatten(F.transform(F.transform(slots, bare), each)))


def _agrees(slots: Column) -> Column:
    """Whether distinct pairs are one to one."""
    way = lambda f: F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s["kind"], s[f]))))
    return (F.size(slots) == way("i")) & (F.size(slots) == way("d"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    bad = materialize(leaks(docs, items, text, key).select(F.col(key).alias("_bad"), F.col("_text").alias("_bad_text")).distinct(), "leaks")
    told = with_partner(docs.withColumn("_text_hash", F.xxhash64(text)), "_text_hash", bad.select("_bad_text"), "_may_hold")
    rest = told.where("_may_hold").join(bad, F.col(key).eqNullSafe(F.col("_bad")) & (F.col("_text_hash") == F.col("_bad_text")), "left_anti")
    return told.where("NOT _may_hold").unionByName(rest).select(*docs.columns)
