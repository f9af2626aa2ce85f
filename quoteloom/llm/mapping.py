"""Freely typed values mapped to the entries of a reference list.

A symmetric-delete dictionary of the reference (every form with up to two letters left out) is broadcast; a
value's own deletions look up candidates, which are verified and ranked by a weighted Damerau-Levenshtein
distance and the entries' frequency. Abbreviations without vowels, cut-off names and swapped words are looked up
as further forms of the reference. What finds nothing within its bound is reported as ``UNMATCHED``.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.session import checkpointed

UNMATCHED = "UNMATCHED"
#: The reference is broadcast whole; a longer one is an error, not a slower plan.
MAX_REFERENCE = 20_000
#: The distinct free values' results, in bytes, up to which they are broadcast to their rows.
MAX_DISTINCT_BYTES = 64 * 1024 * 1024

#: Digits and signs written for letters, and letters that sound alike.
LOOKALIKE = {"0": "o", "1": "l", "3": "e", "5": "s", "4": "a", "@": "a", "$": "s", "!": "i", "7": "t", "8": "b"}
SOUND = [("ph", "f"), ("th", "f"), ("ck", "k"), ("y", "i"), ("ei", "i"), ("ie", "i"), ("ea", "e"), ("ee", "e"), ("er", "a"), ("or", "a"), ("ar", "a"), ("ow", "o"), ("qu", "kw"), ("c", "k"), ("z", "s"), ("oo", "u"), ("ou", "u")]
#: What vendors write around a name, first what says nothing, then what names a tier of cover.
ADDED_WORDS = ["buildings and contents", "building and contents", "contents and buildings", "buildings contents", "household", "insurance", "insurances", "insurer", "ins", "uk", "gb", "ltd", "limited", "plc", "llp", "group", "online", "com", "co", "www", "the", "policy", "buildings", "contents", "underwriting", "services", "quote from", "quoted by", "quote by", "quote", "from", "via", "provided by", "offered by", "by", "ref", "pcw", "renewals", "renewal", "new business", "approx", "tbc"]
TIER_WORDS = ["5 star", "4 star", "3 star", "five star", "star", "extra", "plus", "gold", "silver", "bronze", "platinum", "standard", "premier", "essential", "essentials", "select", "basic"]
HOME_WORDS = ["home and contents", "home contents", "home"]
KEYS = {c: (x, y) for y, row in enumerate(["qwertyuiop", "asdfghjkl", "zxcvbnm"]) for x, c in enumerate(row)}


def fold(text: str) -> str:
    """Lower case without accents, punctuation (and "and", for which "&" stands) as blanks, blanks collapsed."""
    t = unicodedata.normalize("NFKD", text.casefold())
    t = "".join(c for c in t if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub(r"[^\w@$!]+|_|\band\b", " ", t)).strip()


def unlook(text: str) -> str:
    """Look-alike digits within words read as letters; words of digits alone stay."""
    return " ".join(w if w.isdigit() else "".join(LOOKALIKE.get(c, c) for c in w) for w in text.split())


def sound(text: str) -> str:
    t = text
    for a, b in SOUND:
        t = t.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", t)


def skeleton(text: str) -> str:
    """A name's letters without vowels but for those that begin a word."""
    return re.sub(r"(?<=\w)[aeiou]|\s", "", text)


def deletes(word: str, most: int) -> set[str]:
    out = {word}
    for k in range(1, min(most, len(word) - 1) + 1):
        out.update("".join(c for i, c in enumerate(word) if i not in gone) for gone in map(set, combinations(range(len(word)), k)))
    return out


def weighted_distance(a: str, b: str, bound: float = 9.0) -> float:
    """Damerau-Levenshtein (adjacent swaps) with cheaper slips: a doubled letter or blank 0.5, a neighbouring key 0.7, a swap 0.8."""
    n, m = len(a), len(b)
    if abs(n - m) * 0.5 > bound:
        return bound + 1
    before: list[float] = []
    prev = [0.0] * (m + 1)
    for j in range(1, m + 1):
        prev[j] = prev[j - 1] + (0.5 if b[j - 1] == " " or (j > 1 and b[j - 1] == b[j - 2]) else 1.0)
    for i in range(1, n + 1):
        ca = a[i - 1]
        drop = 0.5 if ca == " " or (i > 1 and ca == a[i - 2]) else 1.0
        row = [prev[0] + drop]
        for j in range(1, m + 1):
            cb = b[j - 1]
            if ca == cb:
                best = prev[j - 1]
            else:
                ka, kb = KEYS.get(ca), KEYS.get(cb)
                near = ka and kb and abs(ka[0] - kb[0]) <= 1 and abs(ka[1] - kb[1]) <= 1
                best = prev[j - 1] + (0.7 if near else 1.0)
            best = min(best, prev[j] + drop, row[j - 1] + (0.5 if cb == " " or (j > 1 and cb == b[j - 2]) else 1.0))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb and ca != cb:
                best = min(best, before[j - 2] + 0.8)
            row.append(best)
        before, prev = prev, row
        if min(row) > bound:
            return bound + 1
    return prev[m]


class Dictionary:
    """Reference names and their forms, with the symmetric-delete index over them."""

    def __init__(self, names: Iterable[str], frequency: dict[str, int] | None = None, most_edits: int = 2):
        self.most = most_edits
        self.frequency = frequency or {}
        self.exact: dict[str, set[str]] = {}
        self.index: dict[str, set[tuple[str, str]]] = {}
        self.skeletons: dict[str, set[str]] = {}
        self.plain: dict[str, str] = {}
        for name in names:
            base = fold(name)
            self.plain[name] = base
            words = base.split()
            forms = {base, "".join(words), *(" ".join(words[k:] + words[:k]) for k in range(1, len(words)))}
            for form in forms:
                self.exact.setdefault(form, set()).add(name)
                for d in deletes(form, most_edits):
                    self.index.setdefault(d, set()).add((name, form))
            for d in deletes(sound(base.replace(" ", "")), 1):
                self.index.setdefault("~" + d, set()).add((name, "~" + sound(base.replace(" ", ""))))
            self.skeletons.setdefault(skeleton(base), set()).add(name)
        self.longest = max(map(len, self.exact), default=0)
        self.sorted = sorted((p, n) for n, p in self.plain.items())

    def rank(self, found: dict[str, float]) -> tuple[str, float] | None:
        """The nearest name; of equals the more frequent, then the first by code point."""
        if not found:
            return None
        name = min(found, key=lambda x: (found[x], -self.frequency.get(x, 0), x))
        return name, found[name]

    def near(self, text: str, bound: float) -> tuple[str, float] | None:
        found: dict[str, float] = {}
        if len(text) > self.longest + self.most:
            return None  # farther from every form than the edits allowed
        for name, form in {c for d in deletes(text, self.most) for c in self.index.get(d, ())}:
            w = weighted_distance(text, form, bound)
            if w <= bound:
                found[name] = min(w, found.get(name, 9.0))
        s = sound(text.replace(" ", ""))
        if len(s) >= 5:
            for name, form in {c for d in deletes(s, 1) for c in self.index.get("~" + d, ())}:
                w = 0.6 + weighted_distance(s, form[1:], bound)
                # sounding alike counts only where the names begin alike
                if w <= bound and text[:1] == self.plain[name][:1]:
                    found[name] = min(w, found.get(name, 9.0))
        return self.rank(found)

    def cut(self, text: str) -> str | None:
        """The one name that begins with the text, five letters or more, and goes on beyond it."""
        t = text.replace(" ", "")
        if len(t) < 5:
            return None
        k = bisect_left(self.sorted, (text, ""))
        while k < len(self.sorted) and self.sorted[k][0] == text:
            k += 1
        here = self.sorted[k : k + 2]
        hits = [n for p, n in here if p.startswith(text)]
        return hits[0] if len(hits) == 1 else None


def edit_bound(text: str) -> float:
    n = len(text.replace(" ", ""))
    return 0.0 if n <= 3 else 1.0 if n <= 5 else 2.0 if n <= 7 else 2.5


def brand_mapper(names: list[str], aliases: dict[tuple[str, str], str], frequency: dict[str, int]) -> Callable[[str, str], str]:
    book = Dictionary(names, frequency)
    by_spec: dict[str, dict[str, str]] = {}
    everywhere = {fold(a) for _, a in aliases}
    for (spec, alias), brand in aliases.items():
        by_spec.setdefault(spec, {})[fold(alias)] = brand
    word_list = lambda words: re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")\b")
    added, tiers, home = word_list(ADDED_WORDS), word_list(TIER_WORDS), word_list(HOME_WORDS)
    tidy = lambda t: re.sub(r"\s+", " ", t).strip()

    def mapped(spec: str, text: str) -> str:
        own = by_spec.get(spec, {})
        whole = fold(text)
        bare = tidy(added.sub(" ", re.sub(r"(?<!\w)\d+(?!\w)(?! star)", " ", whole)))
        core = tidy(tiers.sub(" ", bare))
        once = tidy(added.sub(" ", re.sub(r"\b(?:home|house) insurance\b", " ", whole)))
        forms = [t for t in dict.fromkeys((whole, bare, core, once, tidy(re.sub(r" home$", "", bare)), tidy(re.sub(r" home$", "", core)), tidy(home.sub(" ", bare)), tidy(home.sub(" ", core)))) if t]
        for t in forms:
            if t in own:
                return own[t]
            if t in everywhere:
                return UNMATCHED  # a short name holds within its spec only
        tries = dict.fromkeys(t for f in forms for t in (f, unlook(f), f.replace("1", "i")))
        for t in tries:
            if len(book.exact.get(t, ())) == 1:
                return next(iter(book.exact[t]))
        for t in tries:
            j = t.replace(" ", "")
            if len(book.exact.get(j, ())) == 1:
                return next(iter(book.exact[j]))
            k = skeleton(t)
            if len(k) >= 4 and k == j and len(book.skeletons.get(k, ())) == 1:
                return next(iter(book.skeletons[k]))
        for t in tries:
            name = book.cut(t)
            if name:
                return name
        best: dict[str, float] = {}
        for t in tries:
            hit = book.near(t, edit_bound(t))
            if hit:
                best[hit[0]] = min(hit[1], best.get(hit[0], 9.0))
        hit = book.rank(best)
        return hit[0] if hit else UNMATCHED

    return mapped


#: Wordings of a type that share no word with the reference list.
OTHER_WORDINGS: dict[str, str] = {"stand alone": "detached", "standalone": "detached"}


class Phrases:
    """Mapper of free wordings by the phrases of a reference list: ``wordings``, known wording -> canonical type.

    A word that can be left out of every wording without changing its type says nothing and is passed over. Every run of up
    to as many words as a wording has, one more passed over or not, is looked up by symmetric deletion; the match of most words decides, then the nearest,
    the leftmost and the first in the list's order. A word that begins or ends with a wording of one word matches it.
    """

    def __init__(self, wordings: dict[str, str]):
        known: dict[tuple[str, ...], str] = {}
        for w, kind in sorted(wordings.items()):
            known.setdefault(tuple(fold(w).split()), kind)
        words = {x for ws in known for x in ws}
        drop = lambda ws, x: tuple(y for y in ws if y != x)
        fillers = sorted(x for x in words if all(known.get(drop(ws, x)) == kind for ws, kind in known.items() if x in ws))
        self.fillers = Dictionary(fillers)
        self.types: dict[str, str] = {}
        self.weight: dict[str, int] = {}
        for ws, kind in known.items():
            rest = tuple(x for x in ws if x not in fillers) or ws
            for form in (" ".join(ws), " ".join(rest)):
                self.types.setdefault(form, kind)
                self.weight[form] = len(rest)
        self.words = words
        self.book = Dictionary(self.types)
        self.most_words = max((len(t.split()) for t in self.types), default=0)
        self.single = sorted((t for t in self.types if " " not in t and len(t) >= 4), key=lambda t: (-len(t), t))

    def filler(self, word: str) -> bool:
        return word in self.fillers.exact or len(word) >= 4 and self.fillers.near(word, 1.0) is not None and word not in self.book.exact

    def parted(self, word: str) -> str:
        """A word of the list that a filler of four letters or more is written together with, without it."""
        for f in self.fillers.plain.values():
            for rest in (word.removesuffix(f), word.removeprefix(f)):
                if len(f) >= 4 and rest != word and rest in self.words:
                    return rest
        return word

    def whole(self, text: str) -> str | None:
        all_words = text.split()
        words = [self.parted(w) for w in all_words if not self.filler(w)]
        best = None
        for ws in dict.fromkeys((tuple(words), tuple(all_words))):
            for k in range(len(ws)):
                for n in range(min(self.most_words, len(ws) - k), 0, -1):
                    # runs of n words, and of n + 1 with an inner one passed over
                    for run, more in [(ws[k : k + n], 0.0), *[(ws[k:x] + ws[x + 1 : k + n + 1], 0.4) for x in range(k + 1, k + n) if k + n < len(ws)]]:
                        window = " ".join(run)
                        hit = (min(self.book.exact[window]), 0.0) if window in self.book.exact else self.book.near(window, max(edit_bound(window), 1.0 if len(window) >= 3 else 0.0))
                        if hit:
                            rank = (-self.weight[hit[0]], hit[1] + more, k, hit[0])
                            if best is None or rank < best:
                                best = rank
        if best:
            return self.types[best[-1]]
        for w in words:
            for t in self.single:
                if len(w) > len(t) and (w.startswith(t) or w.endswith(t)):
                    return self.types[t]
        return None


def type_mapper(wordings: dict[str, str]) -> Callable[[str, str], str]:
    """Mapper of free property wordings; what stands in brackets is passed over where something stands outside."""
    phrases = Phrases(OTHER_WORDINGS | wordings)

    def mapped(_spec: str, text: str) -> str:
        bare = re.sub(r"\([^)]*\)", " ", text)
        return phrases.whole(unlook(fold(bare if bare.strip() else text))) or UNMATCHED

    return mapped


def mapped_values(quotes: DataFrame, providers: DataFrame, aliases: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((vq_id, spec, field_id, text) of every value that is no canonical name, (spec, field_id, text, n, mapped_to) of the distinct ones).

    Each distinct value is mapped once, and the table of them written once. ``spec`` is empty where it has no part in the
    mapping.
    """
    spark = quotes.sparkSession
    names = [r.brand for r in providers.select("brand").where("brand is not null").distinct().limit(MAX_REFERENCE + 1).collect()]
    short = {(r.spec_name, r.alias_text): r.brand for r in aliases.select("spec_name", "alias_text", "brand").limit(MAX_REFERENCE + 1).collect()}
    wordings = {r.wording: r.building_type for r in types.select("building_type", "wording").limit(MAX_REFERENCE + 1).collect()}
    if max(len(names), len(short), len(wordings)) > MAX_REFERENCE:
        raise ValueError("the reference list is too long to broadcast")
    canonical = sorted(set(wordings.values()))
    wordings = {c: c for c in canonical} | wordings
    q = quotes.select("vq_id", F.coalesce("spec_name", F.lit("")).alias("spec"), F.explode(F.array(
        F.struct(F.lit("brand").alias("field_id"), F.col("brand_text").alias("text")),
        F.struct(F.lit("building_type").alias("field_id"), F.col("property_text").alias("text")),
    )).alias("v")).select("vq_id", F.when(F.col("v.field_id") == "brand", F.col("spec")).otherwise("").alias("spec"), "v.field_id", "v.text").where("text is not null")
    exact = spark.createDataFrame([("brand", n) for n in names] + [("building_type", c) for c in canonical], "field_id string, text string").withColumn("canonical", F.lit(True))
    marked = q.join(F.broadcast(exact), ["field_id", "text"], "left")  # twice MAX_REFERENCE rows at most
    counts = {r.text: r.n for r in marked.where("canonical").groupBy("text").agg(F.count("*").alias("n")).collect()}  # at most a row a canonical name
    free = marked.where("canonical is null").select("vq_id", "spec", "field_id", "text")
    sent = spark.sparkContext.broadcast((names, short, wordings, counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names_, short_, wordings_, counts_ = sent.value
        by_field = {"brand": brand_mapper(names_, short_, counts_), "building_type": type_mapper(wordings_)}
        for pdf in batches:
            yield pdf.assign(mapped_to=[by_field[f](s, t) for s, f, t in zip(pdf["spec"], pdf["field_id"], pdf["text"])])

    parts = 3 * spark.sparkContext.defaultParallelism
    distinct = free.groupBy("spec", "field_id", "text").agg(F.count("*").alias("n")).repartition(parts, "text")
    return free, checkpointed(distinct.mapInPandas(run, "spec string, field_id string, text string, n long, mapped_to string"))


def map_values(quotes: DataFrame, providers: DataFrame, aliases: DataFrame, types: DataFrame, *, max_bytes: int = MAX_DISTINCT_BYTES) -> DataFrame:
    """(vq_id, field_id, mapped_to) for every non-null brand_text and property_text that is not exactly a canonical name.

    Short names hold within their spec only. Texts of blanks alone come out as UNMATCHED. Null texts give no
    row, repeated rows repeat. Ties go to the entry that is exact more often in the data, then to the first by
    code point. A reference of over 20,000 entries is an error. The distinct values' results are broadcast to the rows
    where they come to at most ``max_bytes``, and joined by a shuffle beyond.
    """
    free, mapped = mapped_values(quotes, providers, aliases, types)
    size = mapped.agg(F.sum(F.length("text") * 2 + 120)).first()[0] or 0
    found = mapped.select("spec", "field_id", "text", "mapped_to")
    return free.join(F.broadcast(found) if size <= max_bytes else found, ["spec", "field_id", "text"]).select("vq_id", "field_id", "mapped_to")
