"""Problem 8: subject areas of documents by bisecting k-means and leaf mixtures.

Documents become normalised, idf-weighted word vectors. Bisecting k-means gives first the languages, whose frequent
words hardly overlap, and within each language the leaves; every document goes to its nearest leaf. Of a
collection too large for the driver a draw only starts the centres: passes over all documents then
move them to the means of their documents. A leaf is labelled by its discriminative terms, as far as they are words of the subjects' names and
scopes, and by the raters' labels in it: its mixture of subjects. The counts of terms by leaf then sharpen the
mixtures, as leaves that hold several subjects share their terms with leaves that hold one. The mixtures of all leaves
that hold a term are the term's own mixture, the terms' are a sentence's, with the mixture of its document's
leaf as the prior. So the share of a subject in a document is that of the sentences for which the leaf mixtures
name it. A further class holds sentences that treat no subject: wordings spread over the leaves like the language
itself. A document gets each subject that at least a quarter of its subject sentences treat.

The texts are read twice and kept as packs of sentences, compressed; everything else are six passes over the
packs and, for the centres, some 15 to 30 over the numbers of the documents' words, however large the corpus. No word of any language is given: the words that begin sentences are
those which are written large mostly there.

Defined results: null and blank texts get no subject, neither does a text in which no sentence treats
one; unknown subjects and documents in the labels are ignored, repeated labels of a rater count once,
equal scores go to the smaller subject; documents of any length are read whole. Without labels and
without shared words a leaf's mixture is even.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from hashlib import blake2b
from html import unescape
from unicodedata import combining, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from molweave.llm.sizes import is_item
from molweave.session import cut, spread

LEAVES_PER_SUBJECT = 8
LEAF_ROWS = 8
SAMPLE = 8_192
DIMENSIONS = 1_024
FEATURE_WORDS = 50_000
LANGUAGE_WORDS = 2_000
APART = 0.5
STRANGE = 0.25
SHARE = 0.25
OPENERS = 10_000
OPENER_SHARE = 0.5
OPENER_ROWS = 5
FREQUENT_TERMS = 200_000
FREQUENT_WORDINGS = 20_000
WORDING_ROWS = 20
SPREAD = 0.3
DOUBT = 0.5
KIN = 2.0
STEM = 6
PACK_DOCUMENTS = 256
PACK_LETTERS = 1_000_000
HELD_TERMS = 100_000
MIXED_TERMS = 20_000
STEPS = 30
PRIOR = 0.2
HELD_CODES = 100_000
MOVES = 12
GAIN = 1e-4
DIGITS = 1 << 20
HELD_SUMS = 32_000_000

TAG = re.compile(r"""</?[a-zA-Z][\w:-]*+(?:\s++[\w:-]++(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=]++))?+)*+\s*+/?>|&nbsp;""")
# A line end, two spaces, the space behind a full stop or the one before a list entry.
END = re.compile(r"\s(?:(?<=[\n\r\u2028])|\s|(?<=[.!?]\s)|(?=[-*•]\s))\s*+")
WORD = re.compile(r"[^\W\d_]+")
# Words of reaction strings show by arrows, bonds, brackets or attached branches.
REACTION = re.compile(r"(?<!\S)\S*?(?:>>|[=#@→»]|\[[A-Z]|[A-Za-z0-9]\(|\)[A-Za-z0-9(])\S*+")
BULLETS = "-*•"


def pieces(text: str) -> list[str]:
    """What marks, line ends and reaction strings separate; a reaction string ends its sentence."""
    return [p for p in map(str.strip, END.split(REACTION.sub("rxnstring\n", unescape(TAG.sub("\n", text))))) if p]


def bare(word: str) -> str:
    return word.strip(",'’").split("'")[0].split("’")[0].lower()


def split_sentences(text: str, openers: frozenset[str] = frozenset()) -> list[str]:
    """Normalised wordings of the sentences: lower-case words, numbers left out.

    A list entry that ends without a full stop ends before a large word of ``openers`` behind a small one."""
    out = []
    for piece in pieces(text):
        parts = [piece]
        if piece[0] in BULLETS:
            words = piece.split()
            at = next((i for i in range(3, len(words)) if words[i][:1].isupper() and words[i - 1][:1].islower() and bare(words[i]) in openers), None)
            if at is not None and not piece.isupper():
                parts = [" ".join(words[:at]), " ".join(words[at:])]
        for part in parts:
            words = WORD.findall(part.lower())
            if words:
                out.append(" ".join(words))
    return out


def terms_of(sentence: str, lang: int) -> set[str]:
    """Words and word pairs behind a sign for the language."""
    words, sign = sentence.split(), chr(48 + lang)
    return {sign + w for w in words} | {f"{sign}{a} {b}" for a, b in zip(words, words[1:])}


def _slices(batches: Iterator[pa.RecordBatch], rows: int = PACK_DOCUMENTS) -> Iterator[pa.RecordBatch]:
    """Small batches, so that a worker holds the Python objects of few documents at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


Held = dict[int, Counter]


def _sums(batches: Iterator[pa.RecordBatch], run: Callable[[Iterator[pa.RecordBatch], Held], Iterator[None]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Partial sums of ``key, leaf``, sent whenever many different keys have been met."""
    held: Held = defaultdict(Counter)

    def sent() -> pa.RecordBatch:
        keys = pa.array([k for c in held.values() for k in c], kind)
        leaf = np.repeat(np.array(list(held), np.int32), [len(c) for c in held.values()])
        return pa.record_batch([keys, pa.array(leaf), pa.array([n for c in held.values() for n in c.values()], pa.int64())], ["key", "leaf", "n"])

    for _ in run(batches, held):
        if sum(map(len, held.values())) > HELD_TERMS:
            yield sent()
            held.clear()
    yield sent()


def _summed(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch], Held], Iterator[None]], kind: str = "string") -> DataFrame:
    """``key, leaf, n`` over all rows: what ``run`` counts by key in the counter of a leaf."""
    arrow = pa.string() if kind == "string" else pa.int64()
    return df.mapInArrow(lambda batches: _sums(batches, run, arrow), f"key {kind}, leaf int, n long").groupBy("key", "leaf").agg(F.sum("n").alias("n"))


def _large_words(batches: Iterator[pa.RecordBatch], held: Held) -> Iterator[None]:
    """Large words at the start of a piece (0) and anywhere (1), list entries and shouted pieces left out."""
    for batch in _slices(batches):
        for text in batch.column(1).to_pylist():
            for piece in pieces(text):
                if piece[0] not in BULLETS and not piece.isupper():
                    words = piece.split()
                    held[1].update([bare(w) for w in words if w[0].isupper()])
                    if words[0][0].isupper():
                        held[0][bare(words[0])] += 1
        yield


def openers(items: DataFrame) -> frozenset[str]:
    """Words that are written large mostly at the start of sentences; of more than ``OPENERS`` the most frequent."""
    starts, all_ = (F.sum(F.when(F.col("leaf") == i, F.col("n")).otherwise(0)) for i in (0, 1))
    found = _summed(items, _large_words).groupBy("key").agg(starts.alias("starts"), all_.alias("all"))
    found = found.where((F.col("starts") >= OPENER_ROWS) & (F.col("starts") >= F.col("all") * OPENER_SHARE))
    return frozenset(r["key"] for r in found.orderBy(F.desc("starts"), "key").limit(OPENERS).collect())


# A pack holds the sentences of some documents in one compressed text: a line each, documents apart by a sign.
APART_SIGN = "\x1e"
PACKS = "ids array<long>, pack binary"


def _packed(starts: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str] = []
        letters = 0

        def pack() -> pa.RecordBatch:
            blob = zlib.compress(APART_SIGN.join(texts).encode(), 1)
            return pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["ids", "pack"])

        for batch in _slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append("\n".join(split_sentences(text, starts)))
                letters += len(texts[-1])
                if len(ids) >= PACK_DOCUMENTS or letters >= PACK_LETTERS:
                    yield pack()
                    ids, texts, letters = [], [], 0
        if ids:
            yield pack()

    return run


def unpacked(packs: pa.Array) -> Iterator[list[list[str]]]:
    """The sentences of each document of each pack."""
    for blob in packs:
        yield [t.split("\n") if t else [] for t in zlib.decompress(blob.as_py()).decode().split(APART_SIGN)]


def _doc_words(batches: Iterator[pa.RecordBatch], held: Held) -> Iterator[None]:
    for batch in batches:
        for docs in unpacked(batch.column(1)):
            for doc in docs:
                held[0].update(set(" ".join(doc).split()))
            yield


def _words_in(doc: list[str], number: dict[str, int]) -> list[int]:
    return sorted({number[w] for s in doc for w in s.split() if w in number})


def _mixed(doc: int) -> int:
    """A number of 64 bits that looks random, from a document's id."""
    x = (doc * 0x9E3779B97F4A7C15) % (1 << 64)
    x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) % (1 << 64)
    return x ^ x >> 32


CODED = f"{PACKS}, lengths array<int>, words binary"


def _coded(number: dict[str, int]):
    """Packs with the numbers of each document's words, one document behind the other, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, docs in enumerate(unpacked(batch.column(1))):
                row, words = batch.slice(at, 1), [_words_in(d, number) for d in docs]
                blob = zlib.compress(_flat(words)[1].astype(np.int32).tobytes(), 1)
                yield pa.record_batch([row.column(0), row.column(1), pa.array([[len(w) for w in words]], pa.list_(pa.int32())), pa.array([blob], pa.binary())], ["ids", "pack", "lengths", "words"])

    return run


def decoded(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    """The word numbers of each document of each pack of ``lengths, words``."""
    for lengths, blob in zip(batch.column("lengths").to_pylist(), batch.column("words")):
        yield np.split(np.frombuffer(zlib.decompress(blob.as_py()), np.int32), np.cumsum(lengths)[:-1])


class Space:
    """Word vectors: of the most frequent words, weighted by idf, folded into ``DIMENSIONS`` with signs."""

    def __init__(self, words: list[str], df: np.ndarray, total: int):
        self.idf = np.log((total + 1) / (df + 1)).astype(np.float32)
        h = np.array([int.from_bytes(blake2b(w.encode(), digest_size=4).digest(), "little") for w in words], np.int64)
        self.place, self.sign = h % DIMENSIONS, np.where(h >> 20 & 1, 1, -1).astype(np.float32)

    def vectors(self, docs: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(docs), DIMENSIONS), np.float32)
        row, w = _flat(docs)
        np.add.at(out.reshape(-1), row * DIMENSIONS + self.place[w], self.sign[w] * self.idf[w])
        return unit(out)

    @staticmethod
    def frequent(docs: list[list[int]]) -> np.ndarray:
        """Marks of the very frequent words, by which languages differ."""
        out = np.zeros((len(docs), LANGUAGE_WORDS), np.float32)
        row, w = _flat(docs)
        out[row[w < LANGUAGE_WORDS], w[w < LANGUAGE_WORDS]] = 1
        return out


def _flat(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate([np.zeros(0, np.int64), *(np.asarray(d, np.int64) for d in docs)])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def halves(x: np.ndarray, rng: np.random.Generator, tries: int = 4) -> np.ndarray:
    """A mark for each unit vector of the better of some 2-means: on the side of the second centre."""
    best = None
    for _ in range(tries):
        a = x[rng.integers(len(x))]
        far = np.argsort(x @ a, kind="stable")[: max(1, len(x) // 10)]
        centres = np.stack([a, x[rng.choice(far)]])
        for _ in range(12):
            side = (x @ centres.T).argmax(1) == 1
            if side.all() or not side.any():
                break
            centres = unit(np.stack([x[~side].sum(0), x[side].sum(0)]))
        fit = float((x @ centres.T).max(1).sum())
        if side.any() and not side.all() and (best is None or fit > best[0]):
            best = fit, side
    return best[1] if best else np.zeros(len(x), bool)


def bisect(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Centres of ``k`` leaves: the leaf with the largest spread is halved again and again."""
    rng = np.random.default_rng(seed)
    spread_of = lambda ix: len(ix) - float(np.sqrt((x[ix].sum(0) ** 2).sum()))
    leaves = [np.arange(len(x))]
    gaps = [spread_of(leaves[0])]
    while len(leaves) < k and max(gaps) > 1e-6:
        at = int(np.argmax(gaps))
        side = halves(x[leaves[at]], rng)
        if not side.any():
            gaps[at] = 0.0
            continue
        for part in (leaves[at][~side], leaves[at][side]):
            leaves.append(part)
            gaps.append(spread_of(part) if len(part) >= 2 * LEAF_ROWS else 0.0)
        del leaves[at], gaps[at]
    return unit(np.stack([x[ix].sum(0) for ix in leaves]))


def languages(marks: np.ndarray, seed: int = 5) -> np.ndarray:
    """Centres of the groups of documents whose frequent words hardly overlap. A group is halved as long as the
    shares of the words in its halves are less alike than ``APART``."""
    rng, out, todo = np.random.default_rng(seed), [], [np.arange(len(marks))]
    while todo:
        ix = todo.pop()
        side = halves(unit(marks[ix]), rng) if len(ix) >= 2 * LEAF_ROWS else np.zeros(len(ix), bool)
        parts = [ix[~side], ix[side]]
        shares = [marks[p].mean(0) for p in parts if len(p) >= LEAF_ROWS]
        if len(shares) == 2 and float(unit(shares[0][None])[0] @ unit(shares[1][None])[0]) < APART:
            todo += parts
        else:
            out.append(marks[ix].mean(0))
    return unit(np.stack(out))


class Leaves:
    """Centres of languages and of the leaves in each."""

    def __init__(self, space: Space, tongues: np.ndarray, centres: list[np.ndarray]):
        self.space, self.tongues, self.centres = space, tongues, centres
        self.language_of = [lang for lang, c in enumerate(centres) for _ in c]
        self.first = np.cumsum([0, *map(len, centres)])

    def language(self, marks: np.ndarray) -> np.ndarray:
        return (marks @ self.tongues.T).argmax(1) if len(marks) else np.zeros(0, np.int64)

    def by_language(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language of each document, its marks and how near they are."""
        marks = self.space.frequent(docs)
        near = marks @ self.tongues.T
        return near.argmax(1), marks, near.max(1)

    def by_leaf(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf of each document, its vector and how near it is."""
        spoken, x = self.language(self.space.frequent(docs)), self.space.vectors(docs)
        out, near = np.zeros(len(docs), np.int64), np.zeros(len(docs))
        for lang, centres in enumerate(self.centres):
            mine = spoken == lang
            if mine.any():
                cosines = x[mine] @ centres.T
                out[mine], near[mine] = self.first[lang] + cosines.argmax(1), cosines.max(1)
        return out, x, near


def leaf_centres(x: np.ndarray, documents: int, subjects: int) -> np.ndarray:
    """Centres for the leaves of a language with so many documents, by bisecting ``x``."""
    k = min(LEAVES_PER_SUBJECT * subjects, documents // LEAF_ROWS)
    return bisect(x, k) if k > 1 and len(x) else np.ones((1, DIMENSIONS), np.float32)


Assign = Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]]
SUMS = "group int, n long, near long, total binary"


def _group_sums(assign: Assign, groups: int, width: int):
    """One row a group and task: its documents, how near they are and the sum of their vectors, in whole numbers of
    ``1 / DIGITS``, whose sums do not depend on the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, nears, total = np.zeros(groups, np.int64), np.zeros(groups, np.int64), np.zeros((groups, width), np.int64)
        for batch in batches:
            for docs in decoded(batch):
                group, x, near = assign(docs)
                order = np.argsort(group, kind="stable")
                used, first = np.unique(group[order], return_index=True)
                n[used] += np.diff(np.r_[first, len(group)])
                nears[used] += np.add.reduceat(np.rint(near[order] * DIGITS).astype(np.int64), first)
                total[used] += np.add.reduceat(np.rint(x[order] * DIGITS).astype(np.int64), first, axis=0)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(nears[some]), pa.array([t.tobytes() for t in total[some]], pa.binary())], ["group", "n", "near", "total"])

    return run


def _add_sums(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(t.as_py(), np.int64) for t in table.column("total"))
    n, near = (sum(table.column(c).to_pylist()) for c in ("n", "near"))
    return pa.table({"group": table.column("group")[:1], "n": pa.array([n]), "near": pa.array([near]), "total": pa.array([total.tobytes()], pa.binary())})


def group_sums(coded: DataFrame, assign: Assign, groups: int, width: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Documents of each group, how near all are, and the sum of each group's vectors, over all documents."""
    parts = coded.select("lengths", "words").mapInArrow(_group_sums(assign, groups, width), SUMS)
    if coded.rdd.getNumPartitions() * groups * width * 8 > HELD_SUMS:
        parts = parts.groupBy("group").applyInArrow(_add_sums, SUMS)
    n, near, total = np.zeros(groups, np.int64), 0, np.zeros((groups, width), np.int64)
    for r in parts.collect():  # one row a group, or at most HELD_SUMS bytes
        n[r["group"]] += r["n"]
        near += r["near"]
        total[r["group"]] += np.frombuffer(r["total"], np.int64)
    return n, near, total


def settled(coded: DataFrame, assign: Callable[[np.ndarray], Assign], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres, moved to the means of all their documents until the documents come nearer by less than ``GAIN``, at
    most ``MOVES`` times, and the documents of each. A centre without documents stays."""
    best = 0
    for _ in range(MOVES):
        n, near, total = group_sums(coded, assign(centres), *centres.shape)
        some = total.any(1)
        centres = centres.copy()
        centres[some] = unit(total[some] / DIGITS)
        if near <= best * (1 + GAIN):
            break
        best = near
    return centres, n


Group = Callable[[list[np.ndarray]], np.ndarray]


def _drawn(group_of: Group, shares: np.ndarray):
    """Some documents with their words and group, by the hash of their id; ``shares`` of each group, none of -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, docs in zip(batch.column("ids").to_pylist(), decoded(batch)):
                kept = [(i, int(g), d) for i, g, d in zip(ids, group_of(docs), docs) if g >= 0 and _mixed(i) < shares[g] * (1 << 64)]
                yield pa.record_batch([pa.array([k[j] for k in kept], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.int32())))], ["doc_id", "group", "words"])

    return run


def drawn(coded: DataFrame, group_of: Group, counts: np.ndarray, most: np.ndarray) -> list[list[list[int]]]:
    """The words of at most ``most`` documents of each group, which has ``counts``."""
    picked = coded.select("ids", "lengths", "words").mapInArrow(_drawn(group_of, 1.2 * most / np.maximum(counts, 1)), "doc_id long, group int, words array<int>")
    order = Window.partitionBy("group").orderBy(F.xxhash64("doc_id"), "doc_id")
    limits = F.array(*[F.lit(int(m)) for m in most])[F.col("group")]
    out: list[list[list[int]]] = [[] for _ in most]
    for r in picked.withColumn("at", F.row_number().over(order)).where((F.col("at") <= int(max(most))) & (F.col("at") <= limits)).orderBy("group", "at").collect():
        out[r["group"]].append(r["words"])
    return out


def strange(space: Space, tongues: np.ndarray) -> Group:
    """0 for documents whose frequent words are like no language's, else -1."""

    def run(docs: list[np.ndarray]) -> np.ndarray:
        marks = unit(space.frequent(docs))
        return np.where(marks.any(1) & ((marks @ tongues.T).max(1) < STRANGE), 0, -1)

    return run


def all_languages(coded: DataFrame, space: Space, tongues: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The languages' centres over all documents, and the documents of each.

    A language too rare for the first draw shows by the documents that are like no language. A group of them is one
    if it is like no other and at least half of its words are found mostly in such documents, counted over
    all: short texts of a known language hold words that are found elsewhere. The search goes on until there is no more."""
    while True:
        tongues, counts = settled(coded, lambda c: Leaves(space, c, []).by_language, tongues)
        odd = strange(space, tongues)
        docs = drawn(coded, odd, np.ones(1), np.array([SAMPLE]))[0]
        if len(docs) < LEAF_ROWS:
            return tongues, counts
        _, _, (other, own) = group_sums(coded, lambda x: (odd(x) + 1, space.frequent(x), np.zeros(len(x))), 2, LANGUAGE_WORDS)
        mostly = own > other
        new = [c for c in languages(space.frequent(docs)) if (tongues @ c).max() < APART and c[mostly].sum() >= c.sum() / 2]
        if not new:
            return tongues, counts
        tongues = np.vstack([tongues, *new])


def fitted(coded: DataFrame, space: Space, total: int, subjects: int) -> Leaves:
    """Languages and leaves of all documents.

    Up to ``SAMPLE`` documents are bisected on the driver as they are. Of a larger collection a draw is bisected to
    start with, and passes over all documents move first the languages and then the leaves. A language's number
    of leaves follows from all its documents, and its own draw starts them, however rare it is."""
    docs = drawn(coded, lambda x: np.zeros(len(x), np.int64), np.array([total]), np.array([SAMPLE]))[0]
    marks = space.frequent(docs)
    tongues = languages(marks) if docs else np.ones((1, LANGUAGE_WORDS), np.float32)
    if total <= SAMPLE:
        spoken, x = (marks @ tongues.T).argmax(1), space.vectors(docs)
        return Leaves(space, tongues, [leaf_centres(x[spoken == lang], int((spoken == lang).sum()), subjects) for lang in range(len(tongues))])
    del docs, marks
    tongues, counts = all_languages(coded, space, tongues)
    most = np.full(len(tongues), max(SAMPLE // len(tongues), LEAF_ROWS * LEAVES_PER_SUBJECT * subjects))
    spoken = lambda x: Leaves(space, tongues, []).by_language(x)[0]
    starts = drawn(coded, spoken, counts, most)
    leaves = Leaves(space, tongues, [leaf_centres(space.vectors(d), int(n), subjects) for d, n in zip(starts, counts)])
    del starts
    split = lambda c: Leaves(space, tongues, np.split(c, leaves.first[1:-1]))
    return split(settled(coded, lambda c: split(c).by_leaf, np.concatenate(leaves.centres))[0])


def _leafed(leaves: Leaves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, docs in enumerate(decoded(batch)):
                row = batch.slice(at, 1)
                yield pa.record_batch([row.column(0), row.column(1), pa.array([leaves.by_leaf(docs)[0].tolist()], pa.list_(pa.int32()))], ["ids", "pack", "leaves"])

    return run


def wording(sentence: str) -> int:
    """A number of 64 bits for a sentence of any length."""
    return int.from_bytes(blake2b(sentence.encode(), digest_size=8).digest(), "little", signed=True)


def _wordings(batches: Iterator[pa.RecordBatch], held: Held) -> Iterator[None]:
    for batch in batches:
        for leaves, docs in zip(batch.column(2).to_pylist(), unpacked(batch.column(1))):
            for leaf, doc in zip(leaves, docs):
                held[leaf].update(map(wording, doc))
            yield


def _scope_words(stems: set[str]):
    """Documents of a leaf that hold a word with one of the stems, by word."""

    def run(batches: Iterator[pa.RecordBatch], held: Held) -> Iterator[None]:
        for batch in batches:
            for leaves, docs in zip(batch.column(2).to_pylist(), unpacked(batch.column(1))):
                for leaf, doc in zip(leaves, docs):
                    held[leaf].update([w for w in set(" ".join(doc).split()) if w[:STEM] in stems])
                yield

    return run


def scope_stems(subjects: list[dict]) -> dict[str, set[int]]:
    out: dict[str, set[int]] = {}
    for s in subjects:
        for w in WORD.findall(f"{s['subject'] or ''} {s['scope'] or ''}".lower()):
            if len(w) > 4:
                out.setdefault(w[:STEM], set()).add(s["subject_id"])
    return out


def leaf_mixtures(sizes: dict[int, int], hits: list[tuple[str, int, int]], votes: list[tuple[int, int, int]], subjects: list[dict], leaves: int) -> np.ndarray:
    """Subject mixture (row) of each leaf from ``leaf, subject, votes`` and from discriminative scope words among
    ``word, leaf, documents``."""
    ids = [s["subject_id"] for s in subjects]
    col, stems = {s: j for j, s in enumerate(ids)}, scope_stems(subjects)
    score = np.full((leaves, len(ids)), 0.02)
    for leaf, subject, n in votes:
        if subject in col:
            score[leaf, col[subject]] += n
    # The most frequent word of a stem stands for it.
    most: dict[tuple[str, int], int] = {}
    for word, leaf, n in hits:
        most[word[:STEM], leaf] = max(n, most.get((word[:STEM], leaf), 0))
    whole: Counter = Counter()
    for (stem_, _), n in most.items():
        whole[stem_] += n
    total = sum(sizes.values())
    for (stem_, leaf), n in most.items():
        lift = (n / sizes[leaf]) / (whole[stem_] / total)
        if lift > 1.5 and n > 2:
            for s in stems[stem_]:
                score[leaf, col[s]] += min(3.0, np.log2(lift)) * min(1.0, n / sizes[leaf] * 3) / len(stems[stem_])
    return score / score.sum(1, keepdims=True)


def filler_wordings(counts: DataFrame, language_of: list[int], subjects: int) -> set[int]:
    """Of ``key, leaf, n`` the wordings of ``WORDING_ROWS`` occurrences, of fewer of which the spread cannot be told,
    that are spread over the leaves of their language like the language itself; of more than
    ``FREQUENT_WORDINGS`` the most frequent.

    Spread is the probability that two random occurrences lie in the same leaf. It is the language's own
    for a filler and, if leaves were pure, ``subjects`` times as much for the wordings of one subject; the
    limit lies between the two."""
    whole: dict[int, list[int]] = {}
    for r in counts.groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        whole.setdefault(language_of[r["leaf"]], []).append(r["n"])
    same = {lang: sum(x * x for x in n) / max(sum(n) ** 2, 1) for lang, n in whole.items()}
    found = counts.groupBy("key").agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.max_by("leaf", "n").alias("leaf")).where(F.col("all") >= WORDING_ROWS)
    limits = [(leaf, float(min(subjects**SPREAD * same[lang], same[lang] + 0.3 * (1 - same[lang])))) for leaf, lang in enumerate(language_of) if lang in same]
    # One row for each leaf.
    found = found.join(F.broadcast(counts.sparkSession.createDataFrame(limits or [(-1, 0.0)], "leaf int, most double")), "leaf")
    found = found.where(F.col("pairs") / (F.col("all") * (F.col("all") - 1)) <= F.col("most"))
    return {r["key"] for r in found.orderBy(F.desc("all"), "key").limit(FREQUENT_WORDINGS).collect()}


def stem(word: str) -> str:
    """First letters of a word without accents; what cognates of several languages share."""
    return "".join(c for c in normalize("NFD", word) if not combining(c))[:STEM]


def _from_kin(terms: list[str], counts: np.ndarray) -> np.ndarray:
    """For each word its number of occurrences, spread like its cognates of the other languages."""
    words = [(i, t[0], stem(t[1:])) for i, t in enumerate(terms) if " " not in t and len(t) > 5]
    held: dict[str, dict[str, np.ndarray]] = {}
    for i, lang, key in words:
        by = held.setdefault(key, {})
        by[lang] = by.get(lang, 0) + counts[i]
    out = np.zeros_like(counts)
    for i, lang, key in words:
        others = [v for other, v in held[key].items() if other != lang]
        if others:
            out[i] = counts[i].sum() * sum(others) / max(sum(v.sum() for v in others), 1e-9)
    return out


class TermModel:
    """Log odds of the classes (the subjects, then none) for terms.

    Terms carry the number of their language as their first letter; a language's words are weighed
    against that language's sentences."""

    def __init__(self, terms: list[str], counts: np.ndarray, kin: float):
        counts = counts + kin * _from_kin(terms, counts)
        self.width = counts.shape[1]
        self.weights = np.zeros(counts.shape)
        for lang in sorted({t[0] for t in terms}):
            rows = [i for i, t in enumerate(terms) if t[0] == lang]
            own = counts[rows] + 1e-3
            share = own.sum(0) / own.sum()
            smooth = own + 0.5 * share
            logp = np.log(smooth / smooth.sum(0))
            # Words of any sentence say little, but come in long correlated rows: a term counts by how
            # far its classes are from the language's (relative entropy).
            mine = smooth / smooth.sum(1, keepdims=True)
            far = (mine * np.log(mine / share)).sum(1, keepdims=True)
            logp = far / (far + DOUBT) * (logp - logp.mean(1, keepdims=True))
            self.weights[rows] = logp

    def classes(self, lengths: np.ndarray, codes: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Class of each sentence, given the number of its terms, all terms in a row and its priors; the
        last class, none, without any known term."""
        ends = np.cumsum(lengths)
        out = np.full(len(lengths), self.width - 1)
        at = 0
        while at < len(lengths):
            # As many sentences as have about HELD_CODES terms, at least one.
            first = ends[at] - lengths[at]
            to = max(at + 1, int(np.searchsorted(ends, first + HELD_CODES, "right")))
            score = _segment_sums(self.weights[codes[first : ends[to - 1]]], lengths[at:to]) + prior[at:to]
            out[at:to] = np.where(lengths[at:to] > 0, score.argmax(1), self.width - 1)
            at = to
        return out


def _segment_sums(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    upto = np.vstack([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return upto[ends] - upto[ends - lengths]


def _leaf_terms(language_of: list[int], fillers: set[int]):
    """Terms by leaf, those of fillers as leaf -1."""

    def run(batches: Iterator[pa.RecordBatch], held: Held) -> Iterator[None]:
        for batch in batches:
            for leaves, docs in zip(batch.column(2).to_pylist(), unpacked(batch.column(1))):
                for leaf, doc in zip(leaves, docs):
                    for s in doc:
                        held[-1 if wording(s) in fillers else leaf].update(terms_of(s, language_of[leaf]))
                yield

    return run


def term_mixtures(counts: DataFrame, mixtures: np.ndarray) -> tuple[list[str], np.ndarray]:
    """All terms of ``key, leaf, n`` that occur more than 3 times, of more than ``FREQUENT_TERMS`` the most frequent
    (rarer ones cannot tell of a class), and their occurrences by class: each leaf's shared out like its mixture,
    those of leaf -1 in the last class."""
    width = mixtures.shape[1] + 1
    rows = [(leaf, [*map(float, m), 0.0]) for leaf, m in enumerate(mixtures)] + [(-1, [0.0] * (width - 1) + [1.0])]
    # One row for each leaf.
    table = F.broadcast(counts.sparkSession.createDataFrame(rows, "leaf int, mix array<double>"))
    by = counts.join(table, "leaf").groupBy("key").agg(F.sum("n").alias("all"), *[F.sum(F.col("n") * F.col("mix")[c]).alias(f"c{c}") for c in range(width)])
    by = cut(by.where(F.col("all") > 3))
    if by.count() > FREQUENT_TERMS:
        by = by.orderBy(F.desc("all"), "key").limit(FREQUENT_TERMS)
    found = by.orderBy("key").toArrow()
    return found.column("key").to_pylist(), np.stack([found.column(f"c{c}").to_numpy() for c in range(width)], 1)


def unmixed(held: np.ndarray, counts: np.ndarray, mix: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Leaf mixtures and the terms' occurrences by subject that explain how often the leaves hold the terms.

    ``held`` has a row a term and a column a leaf, ``counts`` the first guess of the occurrences by subject. A leaf's
    expected count of a term is the sum over the subjects of its mixture times the subject's rate of the term;
    multiplicative steps raise the likelihood of all counts, with the first mixture as a prior worth ``PRIOR``
    of a leaf's terms. So leaves whose documents treat several subjects teach which terms belong to which."""
    mix, prior = mix.copy(), mix
    size = held.sum(0)
    rates = counts + 1e-3 * counts.sum(0) / max(counts.sum(), 1e-9) + 1e-9
    rates = rates / rates.sum(0)
    for _ in range(steps):
        ratio = held / np.maximum(rates @ (mix * size[:, None]).T, 1e-12)
        rates = rates * (ratio @ (mix * size[:, None]))
        rates = (rates + 1e-12) / np.maximum(rates.sum(0), 1e-12)
        ratio = held / np.maximum(rates @ (mix * size[:, None]).T, 1e-12)
        mix = mix * (ratio.T @ rates) + PRIOR * prior
        mix /= np.maximum(mix.sum(1, keepdims=True), 1e-12)
    mass = (mix * size[:, None]).sum(0)
    return mix, rates * mass


def refined(counts: DataFrame, mix: np.ndarray, language_of: list[int]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The leaf mixtures and the occurrences by subject of the ``MIXED_TERMS`` most frequent terms, language by language."""
    own = counts.where("leaf >= 0")
    top = own.groupBy("key").agg(F.sum("n").alias("all")).where(F.col("all") > 3).orderBy(F.desc("all"), "key").limit(MIXED_TERMS).select("key")
    found = own.join(F.broadcast(top), "key").toArrow()  # at most MIXED_TERMS rows for each leaf of a language
    keys, leaf, n = found.column("key").to_pylist(), found.column("leaf").to_numpy(), found.column("n").to_numpy()
    terms = sorted(set(keys))
    number = {t: i for i, t in enumerate(terms)}
    at = np.array([number[k] for k in keys], np.int64)
    guess = np.zeros((len(terms), mix.shape[1]))
    np.add.at(guess, at, n[:, None] * mix[leaf])
    guess += KIN * _from_kin(terms, guess)
    mix, out = mix.copy(), {}
    for lang in sorted(set(language_of)):
        leaves = np.flatnonzero(np.array(language_of) == lang)
        mine = [i for i, t in enumerate(terms) if t[0] == chr(48 + lang)]
        if not mine:
            continue
        row, col = np.full(len(terms), -1), np.full(len(mix), -1)
        row[mine], col[leaves] = np.arange(len(mine)), np.arange(len(leaves))
        here = row[at] >= 0
        held = np.zeros((len(mine), len(leaves)))
        held[row[at[here]], col[leaf[here]]] = n[here]
        mix[leaves], shares = unmixed(held, guess[mine], mix[leaves])
        out |= {terms[i]: shares[k] for k, i in enumerate(mine)}
    return mix, out


def _subjects(terms: list[str], model: TermModel, fillers: set[int], language_of: list[int], priors: np.ndarray, ids: list[int]):
    """``doc_id, subject_id, sentences, of``: sentences of each subject, and of any, in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(terms)}
        for batch in batches:
            for doc_ids, leaves, docs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), unpacked(batch.column(1))):
                row, leaf = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.repeat(leaves, [len(d) for d in docs]).astype(np.int64)
                known = [[] if wording(s) in fillers else [number[t] for t in terms_of(s, language_of[x]) if t in number] for x, d in zip(leaves, docs) for s in d]
                lengths = np.array([len(k) for k in known], np.int64)
                found = model.classes(lengths, np.array([c for k in known for c in k], np.int64), priors[leaf])
                n = np.zeros((len(docs), model.width), np.int64)
                np.add.at(n, (row, found), 1)
                doc, subject = np.nonzero(n[:, :-1])
                columns = np.array(doc_ids)[doc], np.array(ids)[subject], n[doc, subject], n[:, :-1].sum(1)[doc]
                yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], ["doc_id", "subject_id", "sentences", "of"])

    return run


def treated(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """``doc_id, subject_id, sentences, of`` for every subject a document's sentences treat."""
    spark = documents.sparkSession
    known = [r.asDict() for r in subjects.where("subject_id is not null").orderBy("subject_id").collect()]
    schema = "doc_id long, subject_id long, sentences long, of long"
    items = spread(documents.where(is_item(F.col("text")) & F.col("doc_id").isNotNull()).select("doc_id", "text"))
    packs = cut(items.mapInArrow(_packed(openers(items)), PACKS))
    total = packs.agg(F.sum(F.size("ids"))).first()[0]
    if not known or not total:
        return spark.createDataFrame([], schema)
    words = _summed(packs, _doc_words).orderBy(F.desc("n"), "key").limit(FEATURE_WORDS).toArrow()
    names = words.column("key").to_pylist()
    space = Space(names, words.column("n").to_numpy(), total)
    coded = cut(packs.mapInArrow(_coded({w: i for i, w in enumerate(names)}), CODED))
    leaves = fitted(coded, space, total, len(known))
    leafed = cut(coded.mapInArrow(_leafed(leaves), f"{PACKS}, leaves array<int>"))
    placed = leafed.select(F.explode(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("leaves").alias("leaf"))).alias("x")).select("x.doc_id", "x.leaf")
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    votes = labels.select("doc_id", "subject_id", "rater").distinct().join(placed, "doc_id").groupBy("leaf", "subject_id").agg(F.count("*").alias("n")).collect()
    hits = [tuple(r) for r in _summed(leafed, _scope_words(set(scope_stems(known)))).collect()]
    mix = leaf_mixtures(sizes, hits, [tuple(v) for v in votes], known, len(leaves.language_of))
    fillers = filler_wordings(cut(_summed(leafed, _wordings, "long")), leaves.language_of, len(known))
    by_term = cut(_summed(leafed, _leaf_terms(leaves.language_of, fillers)))
    mix, sharp = refined(by_term, mix, leaves.language_of)
    terms, counts = term_mixtures(by_term, mix)
    for i, t in enumerate(terms):
        if t in sharp:
            counts[i, :-1] = sharp[t]
    priors = np.hstack([np.log(mix + 0.05), np.full((len(mix), 1), np.log(0.1))])
    run = _subjects(terms, TermModel(terms, counts, KIN), fillers, leaves.language_of, priors, [s["subject_id"] for s in known])
    return leafed.mapInArrow(run, schema)


def assigned_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, subject_id, share``: subjects of at least ``share`` of a document's subject sentences."""
    found = treated(documents, labels, subjects)
    return found.where(F.col("sentences") >= F.col("of") * F.lit(share) - 1e-9).select("doc_id", "subject_id", (F.col("sentences") / F.col("of")).alias("share"))


def makeup(documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE) -> DataFrame:
    """``subject_id, documents, weight, corpus_share``: the corpus by subject; a document's weight of 1 is
    divided among its subjects by their sentences."""
    found = treated(documents, labels, subjects).withColumn("part", F.col("sentences") / F.col("of"))
    by = found.groupBy("subject_id").agg(F.sum((F.col("part") >= share - 1e-9).cast("long")).alias("documents"), F.sum("part").alias("weight"))
    every = subjects.select("subject_id", "subject").where("subject_id is not null").join(by, "subject_id", "left").na.fill(0, ["documents", "weight"])
    whole = Window.partitionBy(F.lit(1))  # a row for each subject
    return every.withColumn("corpus_share", F.coalesce(F.try_divide("weight", F.sum("weight").over(whole)), F.lit(0.0)))
