"""Evaluation passages that stand, wholly or partly, in training text.

The n-grams of the normalised evaluation items are a broadcast hash set; every document's token windows are
scanned against it. N-grams that stand in many items are phrasing that any text of the kind may share: they
raise no suspicion, but count once another n-gram of the item has. Where an item is suspected the passage is
verified: hits are chained into stretches, words between them compared, stretches that repeat the phrasing but
not the item's own words dropped, and the two best in the item's order counted.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of all items together that are still broadcast; more is an error, not a slower plan.
MAX_ITEM_TOKENS = 5_000_000
NGRAM = 3
#: An n-gram raises suspicion if no larger share of the items holds it; a word is an item's own likewise.
OWN_NGRAM, OWN_WORD = 0.02, 0.02
#: A stretch must repeat this share of the item's own words within it.
OWN_REPEATED = 0.5
#: A stretch goes on over so many tokens that differ; between its hits, words count where they are alike.
GAP = 9

#: Letters of other scripts that look like Latin ones.
LOOK = str.maketrans("аеорсухіјѕԁһԛԝвкмнтгАВЕКМНОРСТУХІЈЅԀҺԚԜαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwbkmhtrABEKMHOPCTYXIJSDHQWaeiknoptuxABEZHIKMNOPTYX")
_MARKS = "̀-ͯ­​-‏⁠﻿"
_TOKEN = re.compile(rf"(?:[^\W_]|[{_MARKS}](?=[^\W_{_MARKS}]))(?:[^\W_]|[{_MARKS}]|(?<=\d)[.,](?=\d)|-\r?\n[ \t>*|]*(?=[a-z]))*")
_LINE_MARK = re.compile(r"^[ \t]*(?:\d{1,4}[ \t]*[|:)]|[>*•\-–]+)[ \t]+", re.MULTILINE)
_TAG = re.compile(r"<[^<>\n]{1,80}>|&(?:nbsp|amp|quot|pound|#\d+);")


def plain_token(token: str) -> str:
    """A token without case, accents, look-alike letters, joining marks and group signs in numbers."""
    if token.isascii() and token.isalnum():
        return token.lower()
    t = unicodedata.normalize("NFKD", token).translate(LOOK).casefold()
    return "".join(c for c in t if c.isalnum())


class _Plain(dict):
    """Plain tokens by their spelling, kept up to a bound; a text's words come out of it without a call each."""

    def __missing__(self, token: str) -> str:
        if len(self) > 1_000_000:
            self.clear()
        t = self[token] = plain_token(token)
        return t


_PLAIN = _Plain()


def _unmarked(text: str) -> str:
    for pattern in (_LINE_MARK, _TAG):
        text = pattern.sub(lambda m: " " * (m.end() - m.start()), text)
    return text


def token_list(text: str) -> list[str]:
    """The plain tokens of ``tokens`` without their places."""
    out = list(map(_PLAIN.__getitem__, _TOKEN.findall(_unmarked(text))))
    return out if all(out) else [t for t in out if t]


def tokens(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Plain tokens of a text and where each stands. Line numbers, bullets, quote marks and tags are passed over."""
    out, at = [], []
    for m in _TOKEN.finditer(_unmarked(text)):
        t = _PLAIN[m.group()]
        if t:
            out.append(t)
            at.append(m.span())
    return out, at


def word_weights(text: str) -> tuple[list[str], list[float]]:
    """Plain tokens with weights such that every blank-separated word that holds any weighs one."""
    out, weights = [], []
    for word in text.split():
        got = tokens(word)[0]
        out += got
        weights += [1 / max(1, len(got))] * len(got)
    return out, weights


@lru_cache(maxsize=1_000_000)
def alike(a: str, b: str) -> bool:
    """The same token, or one slip apart in words of four letters or more (two from eight on)."""
    if a == b:
        return True
    n, m = len(a), len(b)
    least = n if n < m else m
    most = 1 if least < 8 else 2
    if least < 4 or n - m > most or m - n > most or a.isdigit() or b.isdigit() or len(set(a) & set(b)) < least - most - (least - len(set(a if n < m else b))):
        return False
    prev = list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [0] * m
        for j in range(1, m + 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (a[i - 1] != b[j - 1]))
        prev = row
        if min(row) > most:
            return False
    return prev[m] <= most


def _between(item: list[str], doc: list[str], i0: int, i1: int, j0: int, j1: int) -> list[int]:
    """Item positions in [i0, i1) that align, in order, with the document's tokens in [j0, j1)."""
    n, m = i1 - i0, j1 - j0
    if n <= 0 or m <= 0:
        return []
    best = [[0] * (m + 1) for _ in range(n + 1)]
    same = [[alike(item[i0 + i], doc[j0 + j]) for j in range(m)] for i in range(n)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if same[i][j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if same[i][j]:
            out.append(i0 + i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def stretches(item: list[str], weights: list[float], own: list[bool], doc: list[str], hits: list[tuple[int, int]], n: int = NGRAM, gap: int = GAP) -> list[tuple[float, int, int, int, int]]:
    """(weight of the item's words repeated, item from, to, document from, to) of each chain of hits.

    ``hits``: (item position, document position) of shared n-grams. A chain moves forward in both by at most
    ``gap`` tokens beyond the last hit, along the diagonal where it can; it is grown at both ends over words
    that align. ``own`` marks the item's own words: a chain that repeats too few of them is phrasing alone.
    """
    hits = sorted(hits, key=lambda h: (h[1], h[0]))
    chains: list[list[tuple[int, int]]] = []
    live: list[list[tuple[int, int]]] = []
    for i, j in hits:
        live = [c for c in live if j <= c[-1][1] + n + gap]
        best = None
        for c in live:
            pi, pj = c[-1]
            if pi < i <= pi + n + gap and pj < j:
                cost = (abs((i - pi) - (j - pj)), -len(c))
                if best is None or cost < best[0]:
                    best = (cost, c)
        if best:
            best[1].append((i, j))
        else:
            chains.append([(i, j)])
            live.append(chains[-1])
    out = []
    for c in chains:
        covered = set()
        for k, (i, j) in enumerate(c):
            covered.update(range(i, i + n))
            if k and (i > c[k - 1][0] + n or j > c[k - 1][1] + n):
                covered.update(_between(item, doc, c[k - 1][0] + n, i, c[k - 1][1] + n, j))
        i0, j0 = c[0]
        i1, j1 = c[-1][0] + n, c[-1][1] + n
        # words at the ends count only where they keep on: at most three apart
        reach = i0
        for i in reversed(_between(item, doc, max(0, i0 - gap), i0, max(0, j0 - gap), j0)):
            if reach - i > 3:
                break
            covered.add(i)
            reach = i
        reach = i1 - 1
        for i in _between(item, doc, i1, min(len(item), i1 + gap), j1, min(len(doc), j1 + gap)):
            if i - reach > 3:
                break
            covered.add(i)
            reach = i
        low, high = min(covered), max(covered) + 1
        inside = [i for i in range(low, high) if own[i]]
        if sum(i in covered for i in inside) < OWN_REPEATED * len(inside):
            continue
        out.append((sum(weights[i] for i in covered), low, high, j0, j1))
    return out


def best_two(found: list[tuple[float, int, int, int, int]], length: int) -> float:
    """The greatest weight of one stretch, or of two that stand in the item's order in the document too.

    ``found``: stretches of an item of ``length`` words. Two may share three words of either, which count once.
    A sweep over the document: ``upto[h]`` is the heaviest stretch so far that ends at the item's word h or before.
    """
    best = max((s[0] for s in found), default=0.0)
    ended = sorted(found, key=lambda s: s[4])
    upto, k = [0.0] * (length + 1), 0
    for w, low, _, start, _ in sorted(found, key=lambda s: s[3]):
        while k < len(ended) and ended[k][4] <= start + 3:
            x, high = ended[k][0], ended[k][2]
            while high <= length and upto[high] < x:
                upto[high] = x
                high += 1
            k += 1
        best = max(best, max(w + upto[h] - (h - low) for h in range(low, min(low + 3, length) + 1) if upto[h]) if upto[min(low + 3, length)] else 0.0)
    return best


class Items:
    """The evaluation items, the hash set of their n-grams and what is an item's own."""

    def __init__(self, rows: list[tuple[int, str]], n: int = NGRAM):
        self.n = n
        self.words: dict[int, list[str]] = {}
        self.weights: dict[int, list[float]] = {}
        self.total: dict[int, float] = {}
        self.places: dict[int, dict[tuple, list[int]]] = {}
        #: Items too short for two n-grams, by their words: they are repeated whole or not at all.
        self.short: dict[tuple, list[int]] = defaultdict(list)
        different = {}
        for item_id, text in rows:
            words, weights = word_weights(text or "")
            if not words:
                continue
            if len(words) <= n:
                self.short[tuple(words)].append(item_id)
                continue
            self.words[item_id], self.weights[item_id], self.total[item_id] = words, weights, sum(weights)
            places = self.places[item_id] = defaultdict(list)
            for i in range(len(words) - n + 1):
                places[tuple(words[i : i + n])].append(i)
            different[tuple(words)] = item_id
        grams = Counter(g for i in different.values() for g in self.places[i])
        words = Counter(w for i in different.values() for w in set(self.words[i]))
        most_grams, most_words = max(4, OWN_NGRAM * len(different)), max(4, OWN_WORD * len(different))
        self.own = {i: [words[w] <= most_words for w in ws] for i, ws in self.words.items()}
        self.suspect: dict[tuple, list[int]] = defaultdict(list)
        for item_id, places in self.places.items():
            rare = [g for g in places if grams[g] <= most_grams]
            for g in rare if len(rare) >= 3 else places:  # an item of phrasing alone is known by that
                self.suspect[g].append(item_id)
        self.suspect = dict(self.suspect)
        self.short_lengths = sorted({len(ws) for ws in self.short})

    def scan(self, text: str, share: float) -> list[tuple[int, float, list[tuple[int, int]]]]:
        """(item, share of its words, character spans of all its stretches) of the items that the text repeats."""
        doc = token_list(text)
        windows = list(zip(*(doc[k:] for k in range(self.n))))
        suspect = self.suspect
        seen: dict[int, int] = Counter()
        for g in suspect.keys() & set(windows):
            for item_id in suspect[g]:
                seen[item_id] += 1
        at: list[tuple[int, int]] = []
        out = []
        for size in self.short_lengths:
            for j, g in enumerate(zip(*(doc[k:] for k in range(size)))):
                if g in self.short:
                    at = at or tokens(text)[1]
                    out += [(item_id, 1.0, [(at[j][0], at[j + size - 1][1])]) for item_id in self.short[g]]
        if self.short_lengths:  # a row an item, with the spans of all its copies
            whole: dict[int, list[tuple[int, int]]] = {}
            for item_id, _, spans in out:
                whole.setdefault(item_id, []).extend(spans)
            out = [(item_id, 1.0, spans) for item_id, spans in whole.items()]
        for item_id, times in seen.items():
            if times < 2:
                continue
            places, total = self.places[item_id], self.total[item_id]
            hits = [(i, j) for j, g in enumerate(windows) if g in places for i in places[g]]
            if len({i + k for i, _ in hits for k in range(self.n)}) < 0.5 * share * total:
                continue
            found = stretches(self.words[item_id], self.weights[item_id], self.own[item_id], doc, hits, self.n)
            w = best_two(found, len(self.words[item_id]))
            if w >= share * total - 1e-9:
                at = at or tokens(text)[1]
                out.append((item_id, w / total, [(at[a][0], at[min(b, len(at)) - 1][1]) for *_, a, b in found]))
        return out


_BUILT: dict[str, Items] = {}


def _built(key: str, rows: list[tuple[int, str]]) -> Items:
    """The items, built once a worker process and table of items."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(rows)
    return _BUILT[key]


def find_leaks(documents: DataFrame, items: DataFrame, *, share: float = 0.4) -> DataFrame:
    """(doc_id, item_id, share, spans): documents that repeat at least ``share`` of an item's words.

    In the item's order, in one stretch or two, some changed words aside; case, accents, look-alike letters,
    punctuation, line numbers and breaks don't count. An item of three words or fewer is repeated only whole. Null and
    empty texts repeat nothing; items without words are repeated by nothing. A document gives one row per item. Items
    of over 5 million tokens in all, counted before they are fetched, are an error: they would no longer be broadcast.
    """
    texts = items.select("item_id", "item_text").where("item_text is not null")
    blanks = F.size(F.split(F.trim("item_text"), r"\s+"))
    total = texts.agg(F.sum(F.greatest(blanks, F.length("item_text") / 16))).first()[0] or 0  # words, and runs without blanks by their length
    if total > MAX_ITEM_TOKENS:
        raise ValueError("the evaluation items are too many to broadcast")
    rows = [(r.item_id, r.item_text) for r in texts.collect()]
    sent = documents.sparkSession.sparkContext.broadcast(rows)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _built(key, sent.value)
        for pdf in batches:
            out = [(d, i, s, [{"start": a, "stop": b} for a, b in spans]) for d, t in zip(pdf["doc_id"], pdf["text"]) if t for i, s, spans in known.scan(t, share)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "share", "spans"])

    ids = documents.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {ids[0]}, item_id {ids[1]}, share double, spans array<struct<start:int,stop:int>>")


def without_leaks(documents: DataFrame, leaks: DataFrame, *, remove: str = "spans") -> DataFrame:
    """``documents`` without the leaked spans of their texts, or without the leaking documents (``remove="documents"``).

    Overlapping spans are joined; a text that is all leak becomes empty. Offsets count characters.
    """
    if remove == "documents":
        return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
    spans = leaks.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"))  # a document's stretches
    both = documents.join(spans, F.col("doc_id") == F.col("_doc"), "left")
    cut = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] > acc["at"], F.concat(acc["kept"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]))).otherwise(acc["kept"]).alias("kept"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        ),
        lambda acc: F.concat(acc["kept"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return both.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut)).select(*documents.columns)
