"""Language identification by interpolated Kneser-Ney character models, one for each language."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, numbered, renamed, staged, table
from .rolling import mix

#: Longest n-gram of characters, and about how many documents of each language the models are fitted and calibrated on.
ORDER, SAMPLE_DOCS = 5, 1500
#: Of clean documents of the sample, how many may be rejected, and by how many bits a letter beyond that rejection starts.
REJECTED_SHARE, SLACK_BITS = 0.001, 1.0

#: Words: letters without digits; everything else only separates. A word is modelled from a leading blank to a closing one.
WORD = re.compile(r"[^\W\d_]+")
COUNTS = "lang string, n int, gram string, count long"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, order: int) -> Iterator[tuple[int, str]]:
    """The n-grams that predict each character of the word and its end: those that end there, of each length from 1 to order."""
    padded = f" {word} "
    for end in range(2, len(padded) + 1):
        for n in range(1, min(order, end) + 1):
            yield n, padded[end - n : end]


def count_pass(order: int):
    """(lang, text) to COUNTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 22):
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, seen in words.items():
                found: Counter = Counter()
                for word, times in seen.items():
                    for gram in grams(word, order):
                        found[gram] += times
                n, gram = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(n, pa.int32()), pa.array(gram, pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "n", "gram", "count"])

    return run


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n codes in a row."""
    out = np.full(len(codes) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix(out ^ codes[i : len(codes) - n + 1 + i].astype(np.uint64))
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def kneser_ney(counts: dict[int, dict[str, int]], order: int, alphabet: int) -> tuple[dict[int, tuple[list[str], np.ndarray, np.ndarray]], float]:
    """For each length: the n-grams, their interpolated log2 probability, and the log2 weight that they, as a context,
    leave to the shorter one; and the log2 probability of a character never seen. counts: the raw counts by length.

    Below the highest order an n-gram counts by the different characters in front of it, but one that begins a word,
    which has none, by itself. The discount of a length is n1 / (n1 + 2 n2) of its counts. The lowest order is
    interpolated with an even distribution over alphabet characters.
    """
    used: dict[int, Counter] = {order: Counter(counts.get(order, {}))}
    for n in range(order - 1, 0, -1):
        used[n] = Counter()
        for gram in counts.get(n + 1, {}):
            used[n][gram[1:]] += 1
        for gram, times in counts.get(n, {}).items():
            if gram[0] == " " and n > 1 or not used[n][gram]:
                used[n][gram] = times
    out: dict[int, tuple[list[str], np.ndarray, np.ndarray]] = {}
    probability: dict[str, float] = {}
    weight: dict[str, float] = {}
    for n in range(1, order + 1):
        by = Counter(used[n].values())
        discount = by[1] / (by[1] + 2 * by[2]) if by[1] and by[2] else 0.5
        total: Counter = Counter()
        kinds: Counter = Counter()
        for gram, times in used[n].items():
            total[gram[:-1]] += times
            kinds[gram[:-1]] += 1
        left = {context: discount * kinds[context] / total[context] for context in total}
        new = {}
        for gram, times in used[n].items():
            below = probability[gram[1:]] if n > 1 else 1 / alphabet
            new[gram] = (times - discount) / total[gram[:-1]] + left[gram[:-1]] * below
        probability = new
        weight |= left
        out[n] = (list(new), np.log2(np.fromiter(new.values(), dtype=np.float64)), np.zeros(0))
    for n, (found, logs, _) in out.items():
        out[n] = (found, logs, np.array([math.log2(weight[g]) if g in weight else 0.0 for g in found]))
    return out, math.log2(weight[""] / alphabet) if "" in weight else -math.log2(alphabet)


@dataclass
class Models:
    """The models of all languages: for each length the sorted hashes of the n-grams that any language has, and beside
    them a column for each language: the probability (NaN where it hasn't the n-gram) and the weight left to shorter ones."""

    langs: list[str]
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    floor: np.ndarray
    reject_above: np.ndarray
    sharpness: float = 1.0

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Bits that each language's model spends on each word and its end; a row for each word."""
        padded = [f" {w} " for w in words]
        sizes = np.array([len(p) for p in padded])
        codes, end = codes_of("".join(padded)), np.cumsum(sizes)
        depth = np.arange(len(codes)) - np.repeat(end - sizes, sizes)  # place in the word
        logs = np.tile(self.floor, (len(codes), 1))
        context = np.zeros_like(logs)  # by its last place, the weight that the n-gram of the length before leaves
        for n, (keys, log, weight) in enumerate(self.tables, 1):
            at = np.flatnonzero(depth >= n - 1)
            if not len(at) or not len(keys):
                break
            h = gram_hashes(codes, n)[at - n + 1]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            # an n-gram that a language hasn't has what its context leaves to the shorter one
            behind = logs[at] + (context[at - 1] if n > 1 else 0.0)
            mine = log[place]
            logs[at] = np.where(hit[:, None] & ~np.isnan(mine), mine, behind)
            context = np.zeros_like(logs)
            context[at] = np.where(hit[:, None], weight[place], 0.0)
        logs[depth == 0] = 0.0
        return -np.add.reduceat(logs, end - sizes, axis=0)


def assemble(langs: list[str], counts: list[dict[int, dict[str, int]]], order: int) -> Models:
    alphabet = 1 + len({g for by in counts for g in by.get(1, {})})
    fitted = [kneser_ney(by, order, alphabet) for by in counts]
    tables = []
    for n in range(1, order + 1):
        grams = sorted({g for f, _ in fitted for g in f[n][0]})
        row = {g: i for i, g in enumerate(grams)}
        logs, weights = np.full((len(grams), len(langs)), np.nan), np.zeros((len(grams), len(langs)))
        for k, (f, _) in enumerate(fitted):
            at = np.fromiter((row[g] for g in f[n][0]), dtype=np.int64, count=len(f[n][0]))
            logs[at, k], weights[at, k] = f[n][1], f[n][2]
        hashes = gram_hashes(codes_of("".join(grams)), n)[::n] if grams else np.zeros(0, dtype=np.uint64)
        order_of = np.argsort(hashes)
        tables.append((hashes[order_of], logs[order_of], weights[order_of]))
    floor = np.array([unseen for _, unseen in fitted])
    return Models(langs, tables, floor, np.full(len(langs), np.inf))


class Scorer:
    """Bits of whole texts by a cache of words, one for each process and set of models."""

    def __init__(self, models: Models, limit: int = 300_000):
        self.models, self.limit = models, limit
        self.known: dict[str, int] = {}
        self.bits = np.zeros((0, len(models.langs)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known, self.bits, new = {}, self.bits[:0], list(words)
        if new:
            parts = [self.models.word_bits(new[i : i + 8192]) for i in range(0, len(new), 8192)]
            self.known.update(zip(new, range(len(self.bits), len(self.bits) + len(new)), strict=True))
            self.bits = np.concatenate([self.bits, *parts])

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits a character of each language, a row for each text; characters, 0 for a text without letters)."""
        words = [words_of(t) for t in texts]
        words = [w if has_letter(w) else [] for w in words]
        self.learn({x for w in words for x in w})
        known = self.known
        out, size = np.zeros((len(texts), len(self.models.langs))), np.zeros(len(texts))
        for i, w in enumerate(words):
            if w:
                size[i] = len(w) + sum(map(len, w))
                out[i] = self.bits[np.fromiter(map(known.__getitem__, w), dtype=np.int64, count=len(w))].sum(axis=0) / size[i]
        return out, size


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() or any(c.isalpha() for c in w) for w in words)


def decide(models: Models, bits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the language of least cross-entropy, the first of equal ones; its share of the calibrated likelihoods;
    whether the text is rejected) for each text."""
    best = bits.argmin(axis=1)
    least = bits[np.arange(len(bits)), best]
    share = 1 / np.exp2(-models.sharpness * np.minimum((bits - least[:, None]) * size[:, None], 1000)).sum(axis=1)
    return best, share, least > models.reject_above[best]


def calibrated(models: Models, texts: list[str], langs: list[str]) -> Models:
    """Sets the sharpness under which shares come true best, and for each language the bits a character beyond which a
    text is rejected: those that REJECTED_SHARE of the language's texts exceed, and SLACK_BITS."""
    bits, size = Scorer(models).entropies(texts)
    of = {lang: k for k, lang in enumerate(models.langs)}
    truth = np.array([of.get(x, -1) for x in langs])
    ok = (size > 0) & (truth >= 0)
    bits, size, truth = bits[ok], size[ok], truth[ok]
    if len(truth):
        losses = []
        for sharpness in 2.0 ** np.arange(-9, 1):
            logits = -sharpness * (bits - bits.min(axis=1, keepdims=True)) * size[:, None]
            losses.append((np.mean(np.log2(np.exp2(np.maximum(logits, -1000)).sum(axis=1)) - logits[np.arange(len(truth)), truth]), sharpness))
        models.sharpness = float(min(losses)[1])
    for k in range(len(models.langs)):
        own = bits[truth == k, k]
        if len(own):
            models.reject_above[k] = np.quantile(own, 1 - REJECTED_SHARE) + SLACK_BITS
    return models


def fit(labelled: DataFrame, *, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models of the languages named in labelled, fitted on about sample_docs different whole texts of each, drawn by the
    hash of the text; a quarter of those are kept back to calibrate. Counts are made on the executors; the driver gets
    the counts and the calibration texts of the sample, whose size doesn't follow the input."""
    rows = labelled.select(labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Models([], [], np.zeros(0), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, sample_docs / sizes[lang]) * (1 << 30)))])
    sample = staged(rows.where(draw < F.element_at(share, F.col("lang"))).distinct(), "sample")
    aside = F.pmod(F.xxhash64(F.lit(12), "text"), F.lit(4)) == 0
    counted = sample.where(~aside).select("lang", "text").mapInArrow(count_pass(order), COUNTS)
    total = counted.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")).toArrow()
    by: dict[str, dict[int, dict[str, int]]] = {lang: {} for lang in langs}
    for lang, n, gram, count in zip(*(total.column(c).to_pylist() for c in ("lang", "n", "gram", "count")), strict=True):
        by[lang].setdefault(n, {})[gram] = count
    held = sample.where(aside).toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    return calibrated(assemble(langs, [by[lang] for lang in langs], order), held.column("text").to_pylist(), held.column("lang").to_pylist())


_scorers: dict[str, Scorer] = {}


def identify(docs: DataFrame, models: Models, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected behind its columns.

    lang_pred: the language whose model spends the fewest bits a character on the whole text, `und` for a text that is
    null or has no letter (or without models). score: from 0 to 1, the language's share of the calibrated likelihoods;
    0 for `und`. rejected: `und`, or more bits than the language's own texts take. Rows aren't moved. Repeated rows
    stay, columns with the new names are replaced, an empty table stays empty.
    """
    docs, old = numbered(docs, ("lang_pred", "score", "rejected"))
    kept = docs.columns
    source = docs.select(*kept, F.coalesce(F.col(f"c{old.index(text_col)}").cast("string"), F.lit("")).alias("__text"))
    shared, name = docs.sparkSession.sparkContext.broadcast(models), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(shared.value)
        scorer = _scorers[name]
        names = np.array([*shared.value.langs, "und"], dtype=object)
        for batch in blocks(batches, "__text"):
            texts = batch.column(len(kept)).to_pylist()
            pred, score, rejected = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            if len(names) > 1:
                bits, size = scorer.entropies(texts)
                known = size > 0
                pred[known], score[known], rejected[known] = decide(shared.value, bits[known], size[known])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(names[pred], pa.string()), pa.array(score), pa.array(rejected)], names=[*kept, "lang_pred", "score", "rejected"])

    found = source.mapInArrow(run, source.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))
    return renamed(found, old, "lang_pred", "score", "rejected")


def held_out(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Whether nothing may be learned from a document: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on_documents(docs: DataFrame) -> Models:
    """Models from the documents that aren't held out; documents without an id aren't learned from."""
    return fit(docs.where(~held_out(docs) & docs["doc_id"].isNotNull()))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs (as the table of that name) without those whose language is rejected, by models of docs itself."""
    named, old = numbered(docs)
    return renamed(identify(named, fit_on_documents(docs), text_col=f"c{old.index('text')}").where("not rejected"), old)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(docs).alias("held_out"), "text")
    return identify(rows, fit_on_documents(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
