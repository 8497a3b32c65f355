"""BPE encoding and decoding by dynamic programming over prefixes.

A byte-pair encoding is a chain of tokens of which each neighbouring pair is
compatible: encoding the pair's joined text alone gives back that pair.  Every
prefix of a word therefore has exactly one possible last token, found among the
vocabulary tokens that end there: the one compatible with the last token of the
prefix before it.  A suffix automaton of the vocabulary walks the word once; its
state is the longest suffix read so far that is part of a token, and its suffix
links list every token that ends at the position, longest first.  One last token
per prefix is stored, and following them back from the end emits the exact ids,
in time linear in the word's length whatever the merges are.

Compatibility of two tokens is decided from their merge trees alone: a merge
across the joint is possible only between a right-edge part of the left token
and a left-edge part of the right one, and spoils the pair if its rank comes
before both parts are merged further.

Scale: no exchange; each executor keeps one automaton (the vocabulary is a
fixed file, sent once as a broadcast of its proven size) and a bounded memo of
words.  Texts are encoded whole, however long.

Defined cases: null text counts as empty (no ids, empty decoded text); strings
of special tokens in a text become their ids, as the tokenizers library does
by default; repeated rows give repeated results; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

MEMO = 300_000  # words of up to 64 characters in each of a worker's two memo generations
NEVER = 1 << 30
END = "\0"  # stands for the end-of-word mark inside the automaton; byte alphabets have no NUL


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """Ids of words seen, in two generations of bounded size."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe, self.before = bpe, {}

    def __missing__(self, w: str) -> bytes:
        if len(self) >= MEMO:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(w)
        if ids is None:
            ids = self.bpe.word(w)
        if len(w) <= 64:
            self[w] = ids
        return ids


class WordBpe:
    """Encoder and decoder of a vocabulary file with ``</w>`` word ends."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.tokens = [""] * (max(max(vocab.values()), *[t["id"] for t in data["added_tokens"]]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.alphabet = byte_alphabet()
        self.table = {b: c for b, c in enumerate(self.alphabet)}
        marks = [t for t in sorted(self.special, key=len, reverse=True)]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")").split if marks else None
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"^\s", r"^\p{White_Space}")).findall
        self._merges(model["merges"], vocab)
        self._automaton(vocab)
        self.fits: dict[int, bool] = {}
        self.memo = Memo(self)

    # -- vocabulary -----------------------------------------------------------
    def _merges(self, merges: list, vocab: dict) -> None:
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = vocab[a], vocab[b]
            self.rank.setdefault((left, right), r)
            parts.setdefault(vocab[a + b], (left, right, r))
        self.parts = parts
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Parts on one edge of a token, largest first, with the rank at which each is merged further."""
        got = self.edges.get((token, side))
        if got is None:
            got, until = [], NEVER
            while token is not None:
                got.append((token, until))
                part = self.parts.get(token)
                token, until = (part[side], part[2]) if part else (None, NEVER)
            self.edges[(got[0][0], side)] = got
        return got

    def _compatible(self, left: int, right: int) -> bool:
        rank, known = self.rank, True
        for a, a_until in self._edge(left, 1):
            for b, b_until in self._edge(right, 0):
                r = rank.get((a, b))
                # on a tie the leftmost merge goes first: the left token's own, or this one
                if r is not None and r < a_until and r <= b_until:
                    known = False
                    break
            if not known:
                break
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[left << 20 | right] = known
        return known

    # -- automaton ------------------------------------------------------------
    def _automaton(self, vocab: dict) -> None:
        """Suffix automaton of all tokens: a state is a class of parts of tokens that end at the same places."""
        self.kids, self.link, self.size = [{}], [-1], [0]
        own: dict[int, int] = {}
        for token, i in vocab.items():
            path = token[: -len(self.suffix)] + END if token.endswith(self.suffix) and len(token) > len(self.suffix) else token
            state = 0
            for c in path:
                state = self._extend(state, c)
            own[state] = i  # a whole token is the longest part of its class, so a state has one at most
        hits: list[tuple] = [()] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            shorter = hits[self.link[state]]
            hits[state] = ((own[state], self.size[state]), *shorter) if state in own else shorter
        self.hits = hits  # tokens ending with a state, longest first
        self.link[0] = 0

    def _state(self, kids: dict, link: int, size: int) -> int:
        self.kids.append(kids)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, state: int, c: str, longer: int) -> int:
        """The class of ``state`` followed by ``c``, parted from the longer parts that ``longer`` also holds."""
        kids, link, size = self.kids, self.link, self.size
        if size[longer] == size[state] + 1:
            return longer
        part = self._state(dict(kids[longer]), link[longer], size[state] + 1)
        link[longer] = part
        while state >= 0 and kids[state].get(c) == longer:
            kids[state][c] = part
            state = link[state]
        return part

    def _extend(self, state: int, c: str) -> int:
        """The class of the token read so far and ``c``; shared beginnings are walked, not added again."""
        kids, link = self.kids, self.link
        known = kids[state].get(c)
        if known is not None:
            return self._split(state, c, known)
        new = self._state({}, 0, self.size[state] + 1)
        while state >= 0 and c not in kids[state]:
            kids[state][c] = new
            state = link[state]
        if state >= 0:
            link[new] = self._split(state, c, kids[state][c])
        return new

    def word_ids(self, symbols: str) -> list[int]:
        """Ids of one word, given in the byte alphabet."""
        n = len(symbols)
        kids, link, length, hits, fits = self.kids, self.link, self.size, self.hits, self.fits
        last, start = [-1] * (n + 1), [0] * (n + 1)
        state = read = 0  # symbols before this place that are a part of some token
        for i, c in enumerate(symbols + END, 1):
            nxt = kids[state].get(c)
            while nxt is None and state:
                state = link[state]
                read = length[state]
                nxt = kids[state].get(c)
            state, read = (0, 0) if nxt is None else (nxt, read + 1)
            if i == n:  # the last symbol carries the end mark, so no token ends just before it
                continue
            for token, size in hits[state]:
                if size > read:  # the class holds the token, but not all of it has been read
                    continue
                begin = i - size
                if begin:
                    left = last[begin]
                    if left < 0:
                        continue
                    fit = fits.get(left << 20 | token)
                    if not (self._compatible(left, token) if fit is None else fit):
                        continue
                at = i if i < n else n
                last[at], start[at] = token, begin
                break
        ids, at = [], n
        while at > 0:
            ids.append(last[at])
            at = start[at]
        return ids[::-1]

    # -- texts ----------------------------------------------------------------
    def normalised(self, text: str) -> str:
        """NFC, then each character lower-cased by itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower() looks at the neighbours of a final sigma
                return "".join(c.lower() for c in text)
        return text.lower()

    def word(self, w: str) -> bytes:
        symbols = w.encode().decode("latin-1").translate(self.table)
        return np.array(self.word_ids(symbols), "<u4").tobytes()

    def _piece(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.words(self.normalised(text))))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.split_special is None or not any(map(text.__contains__, self.special)):
            return self._piece(text)
        return b"".join(np.asarray([self.special[p]], "<u4").tobytes() if p in self.special else self._piece(p) for p in self.split_special(text) if p)

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces: the vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, WordBpe] = {}


def load(spec: str) -> WordBpe:
    """One encoder per worker and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:  # the vocabulary is the driver's own file, never an input table
        return f.read()


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, and ids with the decoded text, or their SHA-256 if ``digests``."""
    spark: SparkSession = docs.sparkSession
    spec = spark.sparkContext.broadcast(vocabulary(path))  # a fixed file of 1.7 MB
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    last = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                decoded = bpe.decode(ids)
                n.append(len(ids) // 4)
                if digests:
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    a.append(np.frombuffer(ids, "<i4"))
                    b.append(decoded)
            first = pa.array(a, pa.string() if digests else pa.list_(pa.int32()))
            names = [x.split()[0] for x in last.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), first, pa.array(b, pa.string())], ["doc_id", "n_tokens", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, {last}")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digests=True)
