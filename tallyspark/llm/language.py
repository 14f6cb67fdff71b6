"""Language identification by cross-parsing: texts are parsed against a suffix automaton of each language.

A text is parsed into phrases, each the longest string at its place that occurs in a language's training text; the language
that needs the fewest phrases, normalised by the logarithm of its training length, has the least cross-entropy and wins.
A parse is a run of a finite automaton (at a dead end the phrase ends and the next begins), so many texts are
parsed in step, one table lookup a character for all of them. Long texts are cut into stretches that are parsed side by
side, each as if a phrase began there; then the parse of the stretch before is carried on into each until it meets the
stretch's own, from where on they are the same. So the phrases are those of the whole text, wherever it was cut."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slices, small_batches, table

#: Characters of training text for each language, and of one training document; a longer document gives stretches of PIECE
#: characters from all over it.
TRAIN_CHARS = 60_000
DOC_CHARS = 3_000
PIECE = 100
#: Training documents that are looked at for each language.
TRAIN_DOCS = 200
#: A text is parsed in stretches of so many characters, side by side; phrases across their bounds are mended afterwards.
STRETCH = 1024
UNKNOWN = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """The transitions, symbol -> state, of each state of the automaton of all substrings of text; state 0 is the first."""
    to, link, size, last = [{}], [-1], [0], 0
    for c in text.tolist():
        new = len(to)
        to.append({}), link.append(0), size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(to)
                to.append(to[q].copy()), link.append(link[q]), size.append(size[p] + 1)
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return to


def folded(text: str) -> str:
    """The text in lower case; what is not a letter separates words, by one space."""
    return NO_LETTERS.sub(" ", text.lower())


@dataclass(frozen=True)
class LanguageModel:
    """languages; alphabet: code points of all training texts' characters; symbol_of: their symbols, and at last that of any
    other character, 0; dense: symbols up to it have columns in steps: for each language and state a row of entries
    2 * next state + (whether a phrase begins); keys, nexts: the transitions of all other symbols, state << 21 | symbol -> state,
    by key; starts: each language's first state; roots: the states of its empty string; bits: log2 of training lengths."""

    languages: list[str]
    alphabet: np.ndarray
    symbol_of: np.ndarray
    dense: int
    steps: np.ndarray
    keys: np.ndarray
    nexts: np.ndarray
    starts: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(folded(text).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, points)
        at[at == len(self.alphabet)] = 0
        return self.symbol_of[np.where(self.alphabet[at] == points, at, -1)]

    def rare_entries(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The entries of states (text, language) for symbols without a column."""

        def follow(state: np.ndarray) -> np.ndarray:
            key = state.astype(np.int64) << 21 | symbol[:, None]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[at] == key, self.nexts[at], -1)

        go = follow(state)
        begin = follow(np.broadcast_to(self.roots, state.shape))
        return np.where(go >= 0, go * 2, np.where(begin >= 0, begin, self.starts) * 2 + 1)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The entries of states (text, language) for each text's next character."""
        rare = np.flatnonzero(c > self.dense)
        entry = self.steps.reshape(-1)[state * (self.dense + 1) + (np.where(c > self.dense, 0, c) if len(rare) else c)[:, None]]
        if len(rare):
            entry[rare] = self.rare_entries(state[rare], c[rare])
        return entry

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each whole text needs in each language."""
        coded = [self.encode(t) for t in texts]
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        owner = np.repeat(np.arange(len(texts)), [-(-len(c) // STRETCH) for c in coded])
        if not len(owner):
            return counts
        chars = np.concatenate(coded)
        sizes = np.array([len(c) for c in coded])
        nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
        start = (np.cumsum(sizes) - sizes)[owner] + nth * STRETCH
        length = np.minimum(STRETCH, sizes[owner] - nth * STRETCH)
        order = np.argsort(-length, kind="stable")
        state = np.broadcast_to(self.starts, (len(owner), len(self.starts))).copy()
        found = np.zeros(state.shape, np.int64)
        own, n = state[order], len(order)
        seen, ends, begin = np.zeros(own.shape, np.int32), length[order], start[order]
        for t in range(int(ends[0])):
            while ends[n - 1] <= t:
                n -= 1
            entry = self.step(own[:n], chars[begin[:n] + t])
            seen[:n] += entry & 1
            own[:n] = entry >> 1
        state[order], found[order] = own, seen
        np.add.at(counts, owner, found + self._carried(chars, start, length, nth > 0, state))
        return counts

    def _carried(self, chars: np.ndarray, start: np.ndarray, length: np.ndarray, follows: np.ndarray, alone_last: np.ndarray) -> np.ndarray:
        """What each stretch's phrases change by when it goes on from the state in which the one before it, if it follows, ends.

        alone_last: the states in which the stretches end, parsed alone. One that never meets its own parse ends in another
        state, and the stretch after it is done again."""
        extra, last = np.zeros(alone_last.shape, np.int64), alone_last.copy()
        todo = np.flatnonzero(follows)
        while len(todo):
            on, t, true, before = todo, 0, last[todo - 1], last[todo]
            alone = np.broadcast_to(self.starts, true.shape)
            extra[todo], last[todo] = 0, alone_last[todo]
            while len(on):
                over = length[on] == t
                last[on[over]] = true[over]
                apart = ~over & (true != alone).any(axis=1)
                on, true, alone = on[apart], true[apart], alone[apart]
                c = chars[start[on] + t]
                a, b = self.step(true, c), self.step(alone, c)
                extra[on] += (a & 1) - (b & 1)
                true, alone, t = a >> 1, b >> 1, t + 1
            after = todo[(last[todo] != before).any(axis=1)] + 1
            todo = after[(after < len(follows)) & follows[np.minimum(after, len(follows) - 1)]]
        return extra


def build(samples: dict[str, str], symbols: int = 60) -> LanguageModel | None:
    """From a training text for each language; None if there is none. All characters of the texts have transitions; the
    most frequent ones of all texts, so many as symbols, are looked up faster."""
    samples = {k: " ".join(folded(v).split()) for k, v in sorted(samples.items())}
    samples = {k: v for k, v in samples.items() if v}
    if not samples:
        return None
    alphabet, n = np.unique(np.frombuffer("".join(samples.values()).encode("utf-32-le"), np.uint32), return_counts=True)
    symbol_of = np.zeros(len(alphabet) + 1, np.int32)
    symbol_of[np.argsort(-n, kind="stable")] = np.arange(1, len(alphabet) + 1)
    dense = min(symbols, len(alphabet))
    tables, keys, nexts, starts, roots, base = [], [], [], [], [], 0
    for text in samples.values():
        links = suffix_automaton(symbol_of[np.searchsorted(alphabet, np.frombuffer(text.encode("utf-32-le"), np.uint32))])
        void = len(links)  # the state between phrases: any character begins one, and ends it too if it occurs nowhere
        size = np.fromiter(map(len, links), np.int64, void)
        own = np.repeat(np.arange(void), size)
        symbol, to = (np.fromiter((x for d in links for x in part(d)), np.int32, len(own)) for part in (dict.keys, dict.values))
        go = np.full((void + 1, dense + 1), -1, np.int32)
        common = symbol <= dense
        go[own[common], symbol[common]] = to[common]
        begin = np.where(go[0] >= 0, go[0], void)
        tables.append(np.where(go >= 0, (go + base) * 2, (begin + base)[None, :] * 2 + 1).astype(np.int32))
        keys.append((own[~common] + base) << 21 | symbol[~common]), nexts.append(to[~common] + base)
        starts.append(base + void), roots.append(base)
        base += void + 1
    keys, nexts = np.concatenate([*keys, [-1]]), np.concatenate([*nexts, [-1]]).astype(np.int32)
    order = np.argsort(keys)
    bits = np.log2([max(2, len(t)) for t in samples.values()])
    return LanguageModel(list(samples), alphabet, symbol_of, dense, np.concatenate(tables), keys[order], nexts[order], np.array(starts, np.int32), np.array(roots, np.int32), bits)


def spread(text: str, most: int) -> str:
    """The text, or if it is longer than most, stretches of it at even distances from its first to its last character."""
    if len(text) <= most:
        return text
    size, n = min(PIECE, most), max(1, most // PIECE)
    return "\n".join(text[at : at + size] for at in ([(len(text) - size) * i // (n - 1) for i in range(n)] if n > 1 else [(len(text) - size) // 2]))


def level(sizes: list[int], most: int) -> int:
    """The largest bound, at least 1, whose parts of all sizes, min(size, bound), are most together."""
    for k, size in enumerate(ordered := sorted(sizes)):
        if size * (len(ordered) - k) > most:
            return max(1, most // (len(ordered) - k))
        most -= size
    return max(sizes, default=1)


def _pieces(text: Column) -> Column:
    """spread() of a text to DOC_CHARS characters, as a column."""
    n = DOC_CHARS // PIECE
    at = lambda i: F.floor((F.length(text) - PIECE) * i / (n - 1)).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(text, at(i), F.lit(PIECE)))
    return F.when(F.length(text) <= DOC_CHARS, text).otherwise(F.array_join(cut, "\n"))


def training_text(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, str]:
    """About TRAIN_CHARS characters for each language from at most TRAIN_DOCS documents each, chosen by a hash of the id.

    All chosen documents give a part: short ones their text, longer ones equally many characters, from all over them."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row per language
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, TRAIN_DOCS / n)).otherwise(share)
    picked = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share * 1_000_000)
    got: dict[str, list[str]] = {}
    picked = picked.select(F.col(lang_col).alias("_l"), F.regexp_replace(text_col, r"\s+", " ").alias("_t"), F.xxhash64(id_col).alias("_h"))
    for lang, text, _ in picked.select("_l", _pieces(F.col("_t")), "_h").orderBy("_h").collect():
        got.setdefault(lang, []).append(text)
    for lang in counts.keys() - got.keys():  # so rare that the hash chose none
        few = rows.filter(F.col(lang_col) == lang).select(F.col(id_col).alias("_i"), F.regexp_replace(text_col, r"\s+", " ").alias("_t"))
        got[lang] = [r["_p"] for r in few.select("_i", _pieces(F.col("_t")).alias("_p")).orderBy("_i").limit(TRAIN_DOCS).collect()]
    out = {}
    for lang, texts in got.items():
        most = level([len(t) for t in texts], TRAIN_CHARS)
        out[lang] = " ".join(spread(t, most) for t in texts)
    return out


def _predicted(batches, model: LanguageModel | None) -> Iterator[pa.RecordBatch]:
    for batch in by_slices(batches, "text", 4 << 20):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if model is not None and texts:
            bits = model.phrases(texts) * model.bits
            for i, row in enumerate(bits):
                if any(c.isalpha() for c in texts[i]):
                    best = int(row.argmin())
                    lang[i] = model.languages[best]
                    score[i] = float((1 / row[best]) / (1 / row).sum())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of each row's whole text: the language with the least cross-entropy, and its share of the
    languages' inverse cross-entropies, 0 to 1; ties go to the first language by name.

    `und` with score 0 for texts that are null, empty or without a letter, and for all without a model. A row per input
    row, repeated or not; a text's other columns are ignored; an empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 2 * TRAIN_CHARS states a language
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _predicted(b, shared.value), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % folds == fold


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the language of every row of documents, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = build(training_text(docs.filter(~held_out("doc_id", 3, 1)), "doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
