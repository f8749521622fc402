"""The language of each document and of each of its stretches, by a byte-level recurrent network.

The network is trained on a bounded sample of labelled rows, on windows in one language and on windows that change it. It labels every
byte of every whole text. The probabilities of the positions, not of sentences, are decoded: the best path over a text's positions pays
for each change of language, less where a sentence ends than within one. A document's language is the one that
its characters' pooled probabilities are for. Pieces between sentence ends are read once, however often they occur.
"""

from __future__ import annotations

import hashlib
import html
import io
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.gru import F32, ByteGru, train
from tidemark.session import shared_folder

#: Rows of each language that the network is trained on at most, and characters of each of them.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 1_500, 4_000
WINDOW, CONTEXT, BATCH = 256, 32, 512
#: What a position's log probability weighs (neighbours say much the same), the least probability it counts with, and
#: what a change of language costs at the end of a sentence and within one.
WEIGHT, LEAST, AT_END, WITHIN = 0.15, 0.01, 3.5, 9.0
#: Pieces a worker remembers before it starts anew, and bytes it reads at once.
REMEMBERED, READ_AT_ONCE = 200_000, 1_000_000

# what a byte above 127 looks like when UTF-8 was read as Latin-1 or Windows-1252
_ODD = {bytes([b]).decode("cp1252", "ignore") or chr(b): b for b in range(128, 256)} | {chr(b): b for b in range(128, 256)}
_MARKUP = re.compile(r"<[A-Za-z!/|?][^<>]*>|https?://\S+|&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]+);|[" + "".join(map(re.escape, _ODD)) + "]{2,}")
_PAD = "̀"  # left out again, as all combining marks are


def _same_length(m: re.Match) -> str:
    """What a piece of markup or of wrongly decoded UTF-8 stands for, in as many characters."""
    s = m[0]
    if s[0] == "<" or s[0] == "h":
        return " " * len(s)
    if s[0] == "&":
        put = html.unescape(s)
    else:
        try:
            put = bytes(_ODD[c] for c in s).decode("utf-8")
        except UnicodeDecodeError:
            return s
    return put + _PAD * (len(s) - len(put)) if len(put) <= len(s) else s


OTHER, LETTER, DROP, BLANK, CLOSER, END, WEAK_END = range(7)


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """The kind and the lower-case compatibility form of every code point (one that would be several characters stays)."""
    kind, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    kind[0x20000:0x40000] = LETTER
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            kind[i] = LETTER
            form = unicodedata.normalize("NFKC", c).lower()
            if len(form) == 1:
                low[i] = ord(form)
        elif c.isspace():
            kind[i] = BLANK
        elif unicodedata.category(c) in ("Mn", "Me", "Cf"):
            kind[i] = DROP
    for c in "\"'”»)":
        kind[ord(c)] = CLOSER
    for c in "。！？；\n\r":
        kind[ord(c)] = END
    for c in ".!?;":
        kind[ord(c)] = WEAK_END
    return kind, low


class Pieces:
    """Texts cut after sentence ends: for each piece its text, its borders and what the network reads of it (lower-case letters, blanks)."""

    def __init__(self, texts: list[str]):
        kinds, low = _characters()
        size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        cps = np.frombuffer("\n".join([*(_MARKUP.sub(_same_length, t) for t in texts), ""]).encode("utf-32-le", "replace"), dtype="<u4")
        kind = kinds[cps]
        first = np.concatenate([[0], np.cumsum(size)])
        # a full stop or the like ends a sentence before a blank, a quote, markup or another end
        after = np.concatenate([kind[1:], np.array([END], np.uint8)])
        nxt = np.concatenate([cps[1:], np.array([10], "<u4")])
        end = (kind == END) | (kind == WEAK_END) & ((after == BLANK) | (after >= CLOSER) | (nxt == 60))
        # with it go the quotes and brackets that follow
        run = end | (kind == CLOSER)
        fresh = np.zeros(len(cps) + 1, dtype=bool)
        fresh[first] = True
        begins = run & (~np.concatenate([[False], run[:-1]]) | fresh[:-1])
        number = np.cumsum(begins, dtype=np.int32) - 1
        has_end = np.zeros(max(1, int(begins.sum())), dtype=bool)
        has_end[number[end]] = True
        stops = run & (~np.concatenate([run[1:], [False]]) | fresh[1:])
        opens = fresh
        opens[1:] |= stops & has_end[np.maximum(number, 0)]
        cut = np.flatnonzero(opens)
        real = np.flatnonzero(kind != DROP)
        is_letter = kind[real] == LETTER
        piece_of = (np.cumsum(opens[:-1], dtype=np.int32) - 1)[real]
        # a letter, or the one blank behind a run of letters
        was = np.concatenate([[False], is_letter[:-1] & (piece_of[1:] == piece_of[:-1])])
        keep = is_letter | was
        # a piece that ends in a letter gets its blank
        gone = np.flatnonzero(is_letter & np.concatenate([piece_of[1:] != piece_of[:-1], [True]]))
        code, owner = np.where(is_letter, low[cps[real]], 32)[keep], piece_of[keep]
        if len(gone):
            at = np.searchsorted(real[keep], real[gone], side="right")
            code, owner = np.insert(code, at, 32), np.insert(owner, at, piece_of[gone])
        wide = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        raw = code.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")
        edge = np.concatenate([[0], np.cumsum(wide)])
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
        stop = np.concatenate([starts[1:], [len(owner)]]).astype(np.int64)
        ids = owner[starts] if len(owner) else np.empty(0, np.int64)
        self.read = [raw[a:b] for a, b in zip(edge[starts].tolist(), edge[stop].tolist())] if len(starts) else []
        self.text = np.searchsorted(first, cut[ids], side="right") - 1 if len(ids) else np.empty(0, np.int64)
        self.start = cut[ids] - first[self.text] if len(ids) else np.empty(0, np.int64)
        self.end = np.minimum(cut[ids + 1] - first[self.text], size[self.text] - 1) if len(ids) else np.empty(0, np.int64)
        # where in its text each character that is read stands
        self.place, self._real, self._keep, self._gone = None, real, keep, gone
        self._starts, self._stop, self._first = starts, stop, first

    def places(self, i: int) -> np.ndarray:
        """The place in its text of each character of piece i."""
        if self.place is None:
            at = self._real[self._keep]
            if len(self._gone):
                spot = np.searchsorted(at, self._real[self._gone], side="right")
                at = np.insert(at, spot, self._real[self._gone] + 1)
            self.place = at
        return self.place[self._starts[i] : self._stop[i]] - self._first[self.text[i]]


def clean(text: str) -> str:
    """Text as the network reads it: markup out, wrongly decoded UTF-8 mended, lower case, what is no letter one blank."""
    return b"".join(Pieces([text]).read).decode() or " "


def plain(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def sentences(text: str) -> list[tuple[int, int]]:
    """Borders of the pieces of a text that have letters, each with what ends it."""
    p = Pieces([text])
    return list(zip(p.start.tolist(), p.end.tolist()))


def _path(scores: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The best language of each step. scores (steps, texts, languages); cost (steps, texts) of a change before the step."""
    best, back = scores[0].copy(), np.zeros(scores.shape, dtype=np.int16)
    for t in range(1, len(scores)):
        top = best.argmax(axis=1)
        other = np.take_along_axis(best, top[:, None], 1) - cost[t][:, None]
        moved = other > best
        back[t] = np.where(moved, top[:, None], np.arange(scores.shape[2])[None, :])
        best = np.where(moved, other, best) + scores[t]
    out = np.empty(scores.shape[:2], dtype=np.int64)
    out[-1] = best.argmax(axis=1)
    for t in range(len(scores) - 1, 0, -1):
        out[t - 1] = np.take_along_axis(back[t], out[t][:, None], 1)[:, 0]
    return out


class Reader:
    """Labels texts with a trained network. Pieces are read once and remembered as units of one language: mostly a piece is one."""

    def __init__(self, net: ByteGru, languages: list[str]):
        self.net, self.languages, self.tables = net, languages, net.tables()
        self._forget()

    def _forget(self) -> None:
        # piece -> (its first unit, number of units); of each unit: scores, summed probabilities, letters, characters up to its end, whether it has words
        self.known: dict[bytes, tuple[int, int]] = {}
        n = len(self.languages)
        self.scores, self.pooled, self.letters, self.chars = np.empty((0, n), np.float32), np.empty((0, n), np.float32), np.empty(0, np.float32), np.empty(0, np.int64)
        self.worded = np.empty(0, dtype=bool)

    def positions(self, texts: list[bytes]) -> np.ndarray:
        """Class probabilities of every byte of all texts, one after the other."""
        step = WINDOW - 2 * CONTEXT
        jobs = [(max(0, at - CONTEXT), min(len(t), at + step + CONTEXT), at, i) for i, t in enumerate(texts) for at in range(0, max(1, len(t)), step)]
        offset = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).tolist()
        out = np.empty((offset[-1], len(self.languages)), np.float32)
        jobs.sort(key=lambda j: j[1] - j[0])
        for k in range(0, len(jobs), BATCH):
            part = jobs[k : k + BATCH]
            longest = part[-1][1] - part[-1][0]
            ids = np.frombuffer(b"".join(texts[i][a:b].ljust(longest) for a, b, _, i in part), dtype=np.uint8).reshape(len(part), longest).T
            q = self.net.probabilities(ids, self.tables)
            for j, (a, _, at, i) in enumerate(part):
                n = min(step, len(texts[i]) - at)
                out[offset[i] + at : offset[i] + at + n] = q[at - a : at - a + n, j]
        return out

    def _learn(self, fresh: list[bytes]) -> None:
        q = self.positions(fresh)
        size = np.array([len(r) for r in fresh], dtype=np.int64)
        first = np.cumsum(size) - size
        b = np.frombuffer(b"".join(fresh), dtype=np.uint8)
        head = (b & 0xC0) != 0x80
        wide = np.diff(np.concatenate([np.flatnonzero(head), [len(b)]]))
        # each byte is its part of a character, a blank none
        w = np.where(b == 32, 0.0, np.repeat(1.0 / wide, wide)).astype(np.float32)[:, None]
        begins = np.concatenate([[True], b[:-1] == 32]) | head & (b >= 0xE0)
        begins[first] = True
        # words, or characters where a language has no blanks
        word = np.flatnonzero(begins)
        words = np.add.reduceat(np.log(np.maximum(q, LEAST)) * np.where(b == 32, F32(0), F32(WEIGHT))[:, None], word, axis=0)
        pooled, letters, chars = np.add.reduceat(q * w, word, axis=0), np.add.reduceat(w[:, 0], word), np.add.reduceat(head.astype(np.int64), word)
        # a lone letter, as in m2, is no word, but an ideograph is
        worded = (letters > 1.5) | (b[word] >= 0xE2)
        at = np.searchsorted(word, first)
        gain = np.add.reduceat(words.max(axis=1), at) - np.add.reduceat(words, at, axis=0).max(axis=1)
        cuts = np.zeros(len(word), dtype=bool)
        cuts[at] = True
        stop = np.concatenate([at[1:], [len(word)]])
        for i in np.flatnonzero(gain > WITHIN).tolist():
            own = words[at[i] : stop[i]]
            path = _path(own[:, None, :], np.full((len(own), 1), WITHIN))[:, 0]
            cuts[at[i] + 1 : stop[i]] |= path[1:] != path[:-1]
        unit = np.flatnonzero(cuts)
        base, upto = len(self.letters), np.cumsum(chars)
        piece = np.searchsorted(at, unit, side="right") - 1
        last = np.concatenate([unit[1:], [len(word)]]) - 1
        number = np.searchsorted(unit, at)
        for r, k, n in zip(fresh, number.tolist(), np.diff(np.concatenate([number, [len(unit)]])).tolist()):
            self.known[r] = (base + k, n)
        self.scores = np.concatenate([self.scores, np.add.reduceat(words, unit, axis=0)])
        self.pooled = np.concatenate([self.pooled, np.add.reduceat(pooled, unit, axis=0)])
        self.letters = np.concatenate([self.letters, np.add.reduceat(letters, unit)])
        self.worded = np.concatenate([self.worded, np.logical_or.reduceat(worded, unit)])
        self.chars = np.concatenate([self.chars, upto[last] - (upto[at] - chars[at])[piece]])

    def read(self, texts: list[str | None]) -> list[tuple[str | None, float | None, list[tuple[int, int, str, float, int, bool]]]]:
        """For each text: language, confidence and stretches (start, end, language, confidence, letters, whether it holds a whole sentence)."""
        out: list[tuple] = [(None, None, [])] * len(texts)
        p = Pieces([t or "" for t in texts])
        if not p.read:
            return out
        if len(self.known) > REMEMBERED:
            self._forget()
        fresh, size = [], 0
        for r in dict.fromkeys(p.read):
            if r not in self.known:
                fresh.append(r)
                size += len(r)
                if size > READ_AT_ONCE:
                    self._learn(fresh)
                    fresh, size = [], 0
        if fresh:
            self._learn(fresh)
        spot = np.array([self.known[r] for r in p.read], dtype=np.int64)
        piece = np.repeat(np.arange(len(spot)), spot[:, 1])
        k = np.arange(len(piece)) - np.repeat(np.cumsum(spot[:, 1]) - spot[:, 1], spot[:, 1])
        unit, doc = spot[piece, 0] + k, p.text[piece]
        last = k == spot[piece, 1] - 1
        start, end = p.start[piece].copy(), p.end[piece].copy()
        for i in np.flatnonzero(~last).tolist():
            end[i] = start[i + 1] = p.places(int(piece[i]))[self.chars[unit[i]] - 1]
        scores = self.scores[unit]
        lang = scores.argmax(axis=1)
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        many = np.diff(np.concatenate([begin, [len(doc)]]))
        # where all units are for one language, so is the best path
        todo = np.flatnonzero(np.minimum.reduceat(lang, begin) != np.maximum.reduceat(lang, begin))
        todo = todo[np.argsort(many[todo], kind="stable")]
        cost = np.where(k > 0, WITHIN, AT_END).astype(np.float32)
        for x in range(0, len(todo), 128):
            part = todo[x : x + 128]
            rows = begin[part][None, :] + np.arange(many[part[-1]])[:, None]
            inside = np.arange(many[part[-1]])[:, None] < many[part][None, :]
            rows = np.minimum(rows, len(doc) - 1)
            path = _path(np.where(inside[..., None], scores[rows], np.float32(0)), np.where(inside, cost[rows], np.float32(1e9)))
            lang[rows[inside]] = path[inside]
        change = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])]))
        own = np.add.reduceat(self.pooled[unit, lang], change)
        letters = np.add.reduceat(self.letters[unit], change)
        # a sentence is whole if it fills its piece, or starts or ends one that lacks the full stop between two languages
        whole = np.logical_or.reduceat((k == 0) | last, change)
        stop = np.concatenate([change[1:], [len(doc)]]) - 1
        pooled, total = np.add.reduceat(self.pooled[unit], begin, axis=0), np.add.reduceat(self.letters[unit], begin)
        main = pooled.argmax(axis=1)
        sure = pooled[np.arange(len(main)), main] / total
        has_words = np.logical_or.reduceat(self.worded[unit], begin)
        for d, m, c, ok in zip(doc[begin].tolist(), main.tolist(), sure.tolist(), has_words.tolist()):
            out[d] = (self.languages[m], c, []) if ok else out[d]
        for d, a, z, c, q, n, w in zip(doc[change].tolist(), start[change].tolist(), end[stop].tolist(), lang[change].tolist(), (own / letters).tolist(), letters.tolist(), whole.tolist()):
            if out[d][0]:
                out[d][2].append((a, z, self.languages[c], q, round(n), w))
        return out


def sample(docs: DataFrame, key: Column, text: Column, label: Column, languages: list[str], per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[bytes], np.ndarray]:
    """Pieces, each with and without accents, and labels of a bounded sample of labelled rows, at most per_language of each label: those whose hashed keys are smallest.

    A label's rows are thinned by their hashes to about twice the sample before they are ordered, so a label that most rows have
    is no burden.
    """
    rows = docs.select(F.xxhash64(key, F.lit(3)).alias("h"), label.alias("l"), text.alias("t")).where(F.col("l").isin(languages) & (F.length("t") > 20))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.empty(0, np.int64)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2.0 * per_language / n + 0.001)))])
    few = rows.where(F.pmod("h", F.lit(1_000_003)) < share[F.col("l")] * 1_000_003).select("h", "l", F.substring("t", 1, SAMPLE_CHARS).alias("t"))
    few = few.withColumn("rn", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("rn") <= per_language)
    got = sorted((r["l"], r["h"], r["t"]) for r in few.select("l", "h", "t").collect())
    pieces = Pieces([t for _, _, t in got])
    texts, labels = [], []
    for raw, i in zip(pieces.read, pieces.text.tolist()):
        if len(raw) > 12:
            texts += [raw, plain(raw.decode()).encode()]
            labels += [languages.index(got[i][0])] * 2
    return texts, np.array(labels, dtype=np.int64)


def fit(texts: list[bytes], labels: np.ndarray, languages: list[str], steps: int = 280) -> ByteGru:
    """A network for the sample."""
    return train(texts, labels, len(languages), steps=steps)


_FITTED: dict[str, ByteGru] = {}


def fitted(spark: SparkSession, texts: list[bytes], labels: np.ndarray, languages: list[str], anew: bool = False) -> ByteGru:
    """The network of a sample: trained once, then kept by the sample's digest in the shared folder; with anew, trained in any case."""
    mark = hashlib.sha256(b"\n".join([",".join(languages).encode(), labels.tobytes(), *texts])).hexdigest()[:32]
    if anew or mark not in _FITTED:
        fs, path = shared_folder(spark, "language-networks")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{mark}.npz")
        if fs.exists(at) and not anew:
            stream = fs.open(at)
            _FITTED[mark] = ByteGru.restored(np.load(io.BytesIO(bytes(stream.readAllBytes()))))
            stream.close()
        else:
            _FITTED[mark] = fit(texts, labels, languages)
            buffer = io.BytesIO()
            np.savez(buffer, **_FITTED[mark].p)
            part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{mark}.{id(buffer)}.part")
            out = fs.create(part, True)
            out.write(bytearray(buffer.getvalue()))
            out.close()
            # the one who comes first is kept: all are the same
            if not fs.rename(part, at):
                fs.delete(part, False)
    return _FITTED[mark]


STRETCH = "array<struct<start:int,end:int,lang:string,confidence:double,letters:int,whole:boolean>>"


def identify(docs: DataFrame, key: str, text: str, label: Column, languages: list[str], per_language: int = SAMPLE_PER_LANGUAGE, anew: bool = False) -> DataFrame:
    """(key, label, lang, confidence, stretches): the language of each document and of each of its stretches.

    Texts that are null, empty or without words have a null language and no stretches. Stretches are in the order of the
    text, with borders in characters of the text as given, and say whether they hold a whole sentence. Every document is read whole; only training uses the
    bounded sample. If no row carries a known label, every language is null. Extra columns are not read. A network that was trained on the same sample before
    is used again, unless anew is set.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), label.cast("string").alias("label"))
    kind = dict(rows.dtypes)["key"]
    texts, labels = sample(docs, F.col(key), F.col(text), label, languages, per_language)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(fitted(spark, texts, labels, languages, anew) if texts else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value, languages) if shared.value else None
        for pdf in batches:
            for at in range(0, len(pdf), 1_024):
                part = pdf.iloc[at : at + 1_024]
                texts = [t if isinstance(t, str) else None for t in part["text"]]
                got = reader.read(texts) if reader else [(None, None, [])] * len(texts)
                stretches = [[dict(zip(("start", "end", "lang", "confidence", "letters", "whole"), s)) for s in g[2]] for g in got]
                yield pd.DataFrame({"key": part["key"].array, "label": part["label"].array, "lang": [g[0] for g in got], "confidence": [g[1] for g in got], "stretches": stretches})

    return rows.mapInPandas(run, f"key {kind}, label string, lang string, confidence double, stretches {STRETCH}").withColumnRenamed("key", key)
