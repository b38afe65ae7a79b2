"""Texts that were decoded with a wrong character encoding.

A multinomial naive Bayes classifier on hashed byte bigrams predicts for each sentence the exact chain of codecs that
garbled it, or that it is clean. It is trained on synthetically garbled records: clean sentences of a bounded sample
of the documents, sent through every chain. A predicted chain is inverted, and only a strictly decodable inversion
that garbles back to the very sentence counts; sentences with U+FFFD have lost bytes and are reported without text.

Only bigrams with a byte above 0x7f are features: everything else is the same in all chains.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents in the training sample at most, chosen by hash; different sentences of them, the characters beyond ASCII and
#: their neighbours in one of these sentences, and sentences for each language and chain, at most.
SAMPLE_DOCS, SAMPLE_SENTENCES, SENTENCE_CHARS, SENTENCES = 6000, 20_000, 600, 250
#: Buckets of the hashed bigrams, and the log odds against the best clean class that a chain needs: legacy chains,
#: and chains from UTF-8, whose strict decodability is itself strong evidence.
BUCKETS, LEGACY_ODDS, UTF8_ODDS = 1 << 13, 3.0, -6.0
MEMO_ENTRIES = 100_000
#: What a legacy inversion has to gain in the mean log likelihood of a bigram as clean text.
GAIN = 1.0
#: Wrong codecs of a text that was garbled again afterwards.
MORE = (">latin-1", ">cp1252", ">cp1250", ">cp1251", ">mac_roman")

PIECES = re.compile(r"(\n|(?<=[.!?]) |(?<=。))")
ODD = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+[\x00-\x7f]?")
DIGIT = re.compile(r"[0-9]")

# Codec chains, as (true codec, wrong codec) steps.
_WIDE = ["cp932", "gb18030", "big5", "euc_jp", "euc_kr"]
_SINGLE = ["latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-15", "cp1255", "cp1256"]
_CYRILLIC = ["cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"]
CHAINS: list[tuple[tuple[str, str], ...]] = (
    [(("utf-8", w),) for w in [*_SINGLE, *_WIDE, "ascii"]]
    + [(("utf-8", a), ("utf-8", b)) for a, b in (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("mac_roman", "mac_roman"), ("cp1251", "cp1251"))]
    + [((a, b),) for a in _CYRILLIC for b in [*_CYRILLIC, "cp1252", "latin-1", "mac_roman", "cp437"] if a != b]
    + [((a, b),) for a in ("cp1253", "cp737") for b in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437")]
    + [((a, b),) for a in ("cp1252", "mac_roman", "cp437", "cp850") for b in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "koi8-r") if a != b and (a, b) != ("cp1252", "latin-1")]
    + [((a, b),) for a in ("gb18030", "big5", "cp932", "euc_jp") for b in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251")]
    + [((a, b),) for a, b in (("gb18030", "big5"), ("big5", "gb18030"), ("euc_jp", "cp932"), ("cp932", "euc_jp"), ("gb18030", "cp932"), ("cp932", "gb18030"))]
    + [((a, "utf-8"),) for a in ("cp1252", "cp1251", "cp1253", "gb18030", "cp932")]
)

_tables: dict[str, tuple[dict[str, bytes], list[str]]] = {}


def _table(codec: str) -> tuple[dict[str, bytes], list[str]]:
    """Characters of a single-byte codec both ways; bytes that it leaves undefined stand for the control of that number."""
    if codec not in _tables:
        chars = [bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)]
        back: dict[str, bytes] = {}
        for b in range(255, -1, -1):
            back[chr(b)] = bytes([b]) if 0x80 <= b < 0xA0 else back.get(chr(b), b"")
        back = {c: b for c, b in back.items() if b}
        back |= {c: bytes([b]) for b, c in enumerate(chars)}
        _tables[codec] = back, chars
    return _tables[codec]


def single(codec: str) -> bool:
    return codec != "utf-8" and codec != "ascii" and codec not in _WIDE


def wrong(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """``text`` as the chain garbles it; None if a true codec lacks a character."""
    for true, bad in chain:
        try:
            data = text.encode(true)
        except UnicodeEncodeError:
            return None
        text = "".join(map(_table(bad)[1].__getitem__, data)) if single(bad) else data.decode(bad, "replace")
    return text


def right(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The inverse of ``wrong``; None unless every step is strictly decodable and garbles back to the same text."""
    out = text
    if chain[-1][1] in ("utf-8", "ascii"):  # bytes are lost
        return None
    for true, bad in reversed(chain):
        try:
            if single(bad):
                back = _table(bad)[0]
                data = b"".join(map(back.__getitem__, out))
            else:
                data = out.encode(bad)
            out = data.decode(true)
        except (UnicodeError, KeyError):
            return None
    return out if out != text and wrong(out, chain) == text else None


def buckets(text: str) -> np.ndarray:
    """Hashed byte bigrams around the characters beyond ASCII; digits count as one."""
    data = np.frombuffer(DIGIT.sub("0", text).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    if len(data) < 2:
        data = np.concatenate([data, np.array([32], np.int64)])
    high = data >= 128
    pairs = (data[:-1] << 8 | data[1:])[high[:-1] | high[1:]]
    return (pairs * 40503 >> 3) % BUCKETS


class Model:
    """Log probabilities, classes by buckets; the first ``clean`` classes are clean text by language."""

    def __init__(self, weights: np.ndarray, prior: np.ndarray, chains: list) -> None:
        self.weights, self.prior, self.chains, self.clean = weights, prior, chains, len(prior) - len(chains)
        self.memo: dict[str, list[tuple[int, float]]] = {}
        self.tried: dict[str, list[tuple[int, float]]] = {}

    def ranked(self, text: str) -> list[tuple[int, float]]:
        """Chains that might have garbled a sentence, best first, with their log odds against the best clean class."""
        key = DIGIT.sub("0", "\n".join(ODD.findall(text)))
        found = self.memo.get(key)
        if found is None:
            scores = self.prior + self.weights[buckets(key)].sum(0, dtype=np.float64)
            odds = scores[self.clean :] - scores[: self.clean].max()
            found = [(i, float(odds[i])) for i in np.argsort(-odds, kind="stable").tolist() if odds[i] > UTF8_ODDS]
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[key] = found
        return found

    def viable(self, text: str) -> list[tuple[int, float]]:
        """The ranked chains with odds enough; those from UTF-8 only if what lies beyond ASCII is strictly decodable.

        That depends on the characters beyond ASCII and their neighbours alone, so it is remembered by them.
        """
        key = DIGIT.sub("0", "\n".join(ODD.findall(text)))
        found = self.tried.get(key)
        if found is None:
            found = [(i, odds) for i, odds in self.ranked(text) if (right(key, self.chains[i]) is not None if self.chains[i][-1][0] == "utf-8" else odds >= LEGACY_ODDS)]
            if len(self.tried) >= MEMO_ENTRIES:
                self.tried.clear()
            self.tried[key] = found
        return found

    def likely(self, text: str) -> float:
        """Log likelihood of a text as clean text of its best language."""
        if text.isascii():
            return 0.0
        return float((self.prior[: self.clean] + self.weights[buckets("\n".join(ODD.findall(text))), : self.clean].sum(0, dtype=np.float64)).max())

    def average(self, text: str) -> float:
        """Log likelihood of a text as clean text per bigram; 0 for ASCII."""
        return self.likely(text) / max(1, len(buckets("\n".join(ODD.findall(text))))) if not text.isascii() else 0.0

    def options(self, text: str) -> list[tuple[float, str, str]]:
        """Valid inversions of a sentence, best first: score, chain, original.

        What was garbled several times is inverted as often as that makes it likelier; every inversion is shorter.
        """
        if text.isascii():
            return []
        out = []
        for i, odds in self.viable(text):
            chain = self.chains[i]
            original = right(text, chain)
            if original is None or "\ufffd" in original:
                continue
            if chain[-1][0] != "utf-8" and self.average(original) < self.average(text) + GAIN:
                continue  # no nearer to clean text than before
            name, score = " ".join(f"{a}>{b}" for a, b in chain), odds + self.likely(original)
            if chain[-1][0] == "utf-8" and len(original) < len(text):  # garbled once more: only by way of UTF-8
                more = [x for x in self.options(original) if x[1].endswith(MORE)]
                if more and more[0][0] > self.likely(original):
                    out.append((score + more[0][0] - self.likely(original), more[0][1] + " " + name, more[0][2]))
            out.append((score, name, original))
        return sorted(out, key=lambda x: -x[0])

    def document(self, text: str | None) -> tuple[bool, str | None, bool, list[str]]:
        """``(garbled, restored text, whether all of it, chains)`` of a document.

        A document was garbled by one chain as a rule: the chain that fits most of its sentences goes first.
        """
        if not text or text.isascii():
            return False, None, False, []
        pieces = PIECES.split(text)
        fits = {i: found for i, p in enumerate(pieces) if p and (found := self.options(p))}
        lost = [i for i, p in enumerate(pieces) if "\ufffd" in p and i not in fits]
        if not fits and not lost:
            return False, None, False, []
        votes: Counter = Counter()
        for found in fits.values():
            for score, name, _ in found:
                votes[name] += 1 + 1e-3 * (score >= found[0][0])
        names: dict[str, None] = {}
        for i, found in fits.items():
            _, name, pieces[i] = max(found, key=lambda x: (votes[x[1]], x[0]))
            names[name] = None
        for i in lost:
            best = self.ranked(pieces[i])
            names[" ".join(f"{a}>{b}" for a, b in self.chains[best[0][0]]) if best else "lost"] = None
        return True, "".join(pieces), not lost, list(names)


def _utf8_like(text: str) -> bool:
    return "�" in text or any(right(text, (("utf-8", w),)) for w in ("cp1252", "cp1250", "cp1251", "cp1253", "mac_roman", "cp437", "cp850", "cp932", "gb18030"))


def sentences(text: str | None) -> list[str]:
    """What is learnt from the sentences of a text: their characters beyond ASCII with their neighbours."""
    return [DIGIT.sub("0", " ".join(ODD.findall(p))) for p in PIECES.split(text or "") if p and not p.isascii()]


def fit(sample: list[tuple[str | None, str]]) -> Model:
    """The classifier from (language or None, text) rows; deterministic for the same rows."""
    return fit_sentences([(lang, key, n) for lang, text in sample for key, n in Counter(sentences(text)).items()])


def fit_sentences(rows: list[tuple[str | None, str, int]]) -> Model:
    """The classifier from (language or None, sentence, count) rows (see ``sentences``).

    Sentences that already look garbled are left out, first by strict decodability, then by a first model.
    """
    by: dict[str, Counter] = defaultdict(Counter)
    for lang, key, n in rows:
        by[lang or ""][key] += n
    clean = {lang: Counter({k: n for k, n in keys.items() if not _utf8_like(k)}) for lang, keys in by.items()}
    # a rare sentence that is a garbled form of a frequent one is not clean either
    forms: dict[str, int] = {}
    for keys in clean.values():
        for k, n in sorted(keys.items(), key=lambda x: (-x[1], x[0]))[:SENTENCES]:
            for chain in CHAINS:
                bad = wrong(k, chain) if n >= 5 else None
                if bad is not None and bad != k:
                    forms[bad] = max(forms.get(bad, 0), n)
    for keys in clean.values():
        for k in list(keys):
            if keys[k] * 5 <= forms.get(k, 0):
                del keys[k]
    model = _train(clean)
    for keys in clean.values():
        for k in list(keys):
            # one sentence of a kind may be a garbled one; frequent kinds are the language itself
            if model.options(k):
                del keys[k]
    return _train(clean)


def _train(clean: dict[str, Counter]) -> Model:
    langs = sorted(lang for lang, keys in clean.items() if keys) or [""]
    counts, sizes = [], []
    for lang in langs:
        row = np.zeros(BUCKETS)
        for k, n in clean.get(lang, Counter()).items():
            np.add.at(row, buckets(k), n)
        counts.append(row)
        sizes.append(sum(clean.get(lang, Counter()).values()) + 1.0)
    kept = []
    for chain in CHAINS:
        row, seen = np.zeros(BUCKETS), 0
        for lang in langs:
            for k, _ in sorted(clean.get(lang, Counter()).items(), key=lambda x: (-x[1], x[0]))[:SENTENCES]:
                bad = wrong(k, chain)
                if bad is not None and bad != k and not bad.isascii():
                    np.add.at(row, buckets(bad), 1)
                    seen += 1
        if seen:
            kept.append(chain)
            counts.append(row)
            sizes.append(seen)
    table = np.stack(counts) if counts else np.zeros((1, BUCKETS))
    weights = np.log(table + 0.05) - np.log(table.sum(1, keepdims=True) + 0.05 * BUCKETS)
    prior = np.full(len(langs) + len(kept), np.log(0.03 / max(1, len(kept))))
    share = np.array(sizes[: len(langs)])
    prior[: len(langs)] = np.log(0.97 * share / share.sum())
    return Model(np.ascontiguousarray(weights.T.astype(np.float32)), prior, kept)


def sample(df: DataFrame, key: str, text: str, lang: str) -> list[tuple[str | None, str, int]]:
    """The sentences of ``SAMPLE_DOCS`` documents at most; no text goes to the driver, only hashes and short sentences.

    Of more than ``SAMPLE_SENTENCES`` the most frequent ones, none with more than ``SENTENCE_CHARS``: 20 MB at most.
    """
    whole = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text))
    pool = df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(whole.alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    best = pool.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h").alias("h")).first()
    if best is None or best["h"] is None:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(name, k) for name, t in zip(*(c.to_pylist() for c in batch.columns)) for k in sentences(t) if len(k) <= SENTENCE_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["lang", "key"])

    rows = pool.where(F.col("h") <= best["h"]).select("lang", "text").mapInArrow(run, "lang string, key string")
    top = rows.groupBy("lang", "key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "key").limit(SAMPLE_SENTENCES)
    return [(r["lang"], r["key"], r["n"]) for r in top.collect()]


def detect(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key``, restored, complete and chains of every document with a garbled passage.

    ``restored`` is the text with every restorable passage mended; ``complete`` is false where bytes were lost
    (U+FFFD). Null, empty and ASCII texts are clean. Rows with a null key come out with a null key; repeated rows
    repeatedly. The model (under 8 MB, whatever the data) is fitted on ``SAMPLE_DOCS`` documents at most.
    """
    model = fit_sentences(sample(df, key, text, lang))
    shipped = df.sparkSession.sparkContext.broadcast((model.weights, model.prior, model.chains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Model(*shipped.value)
        for batch in batches:
            keys = batch.column(0)
            hits, out = [], []
            for i, text_ in enumerate(batch.column(1).to_pylist()):
                found = one.document(text_)
                if found[0]:
                    hits.append(i)
                    out.append(found)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(hits, pa.int64())), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.bool_()), pa.array([x[3] for x in out], pa.list_(pa.string()))],
                names=[key, "restored", "complete", "chains"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, restored string, complete boolean, chains array<string>")
