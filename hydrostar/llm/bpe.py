"""Operator 2, BPE encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of every new word of a batch.  A
token sequence is the BPE encoding of its word exactly when every adjacent
pair of tokens, merged on its own, stays that pair; one vectorised lookup
tests all adjacent pairs of the batch at once, and only words with a failing
pair are merged exactly.  Pairs are merged once, words once per cache life.

The vocabulary file is a parameter.  The driver reads it and broadcasts its
text (``MAX_VOCABULARY_BYTES`` at most), so executors need no copy of it.
Normalisation and word splitting are those of the file: its own, by the
library, or for the one pair of them that ``PLAIN_RULES`` names an equal cut in
one pass.  A file that needs anything else (no byte-level symbols, a
continuing prefix, dropout, added tokens that bend their surroundings) is
refused.  Vocabularies without an end-of-word suffix give the proposal no word
ends; their words are all merged exactly.  There is no shuffle;
a task holds one slice of texts and bounded caches, and nothing stays in the
worker after it.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrostar.llm.common import arrow_pass

MAX_VOCABULARY_BYTES = 64 << 20
MAX_CACHED_WORDS = 200_000
MAX_CACHED_PAIRS = 1_000_000
# Longer words are merged one by one, from a heap.
MAX_ROUND_SYMBOLS = 64
NO_RANK = 1 << 40

# White space as the Unicode property has it; str.split() also cuts here:
_MORE_CUTS = "\x1c\x1d\x1e\x1f"
_WHITE_SPACE = re.compile(
    "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
)
# Fixed value: the normaliser and word splitter that the next pattern equals
# for Latin-1 text, where composing does nothing: letters and numbers spelt
# out, white space left out.
PLAIN_RULES = (
    {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {
                    "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
                },
                "behavior": "Removed",
                "invert": True,
            },
            {
                "type": "ByteLevel",
                "add_prefix_space": False,
                "trim_offsets": True,
                "use_regex": False,
            },
        ],
    },
)
_CLASS = {
    kind: "".join(
        re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind
    )
    for kind in "LN"
}
_PLAIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_CLASS['L']}]+|[{_CLASS['N']}]"
    rf"|[^{_CLASS['L']}{_CLASS['N']}\t-\r \x85\xa0]+"
)
# Byte-level symbols: printable Latin-1 bytes stand for themselves, the others
# follow from U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SYMBOL = dict(zip((b for b in range(256) if b not in _SELF), range(256, 512)))
# Stands for the end-of-word suffix while words are matched.
_END = "\x00"


class Merger:
    """Exact BPE of one word, and the table of compatible token pairs."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        codes = [(self.vocab[a] << 32 | self.vocab[b], k, self.vocab[a + b]) for (a, b), k in self.ranks.items()]
        self.pair_codes, self.pair_ranks, self.pair_whole = np.array(sorted(codes), np.int64).T.copy()
        self.sizes = np.zeros(max(self.vocab.values()) + 1, np.int64)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items() if self.suffix else ():
            plain = token.removesuffix(self.suffix) + _END if token.endswith(self.suffix) else token
            self.automaton.add_word(plain, i)
            self.sizes[i] = len(plain)
        if self.suffix:
            self.automaton.make_automaton()
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()}
        self.known = np.empty(0, np.int64)
        self.fits = np.empty(0, bool)

    def symbols(self, token: str) -> list[str]:
        """The symbols a token is merged from (the last one has the suffix)."""
        if self.suffix and token.endswith(self.suffix):
            chars = list(token[: -len(self.suffix)])
            chars[-1] += self.suffix
            return chars
        return list(token)

    def merge(self, symbols: list[str]) -> list[str]:
        """Exact merging: always the best ranked pair, the leftmost of equals."""
        rank, n, none = self.ranks.get, len(symbols), 1 << 30
        symbols = list(symbols)
        if n <= 64:
            ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
            while ranks:
                best = min(ranks)
                if best == none:
                    break
                at = ranks.index(best)
                whole = symbols[at] + symbols[at + 1]
                symbols[at : at + 2] = [whole]
                del ranks[at]
                if at:
                    ranks[at - 1] = rank((symbols[at - 1], whole), none)
                if at < len(ranks):
                    ranks[at] = rank((whole, symbols[at + 1]), none)
            return symbols
        ranks = self.ranks
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(ranks[p], k, *p) for k, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if gone[k] or j >= n or symbols[k] != a or symbols[j] != b:
                continue
            symbols[k], gone[j], after[k] = a + b, True, after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n and (p := (symbols[left], symbols[right])) in ranks:
                    heapq.heappush(heap, (ranks[p], left, *p))
        return [s for s, out in zip(symbols, gone) if not out]

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest matches of all words in one scan: token ids, the
        word of each, and for each word whether its tokens cover it."""
        text = _END.join(words) + _END
        matches = list(self.automaton.iter_long(text)) if self.suffix else []
        if not matches:
            none = np.empty(0, np.int64)
            return none, none, np.zeros(len(words), bool)
        ends, ids = zip(*matches)
        ends, ids = np.array(ends, np.int64) + 1, np.array(ids, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        stop = np.cumsum(sizes)
        owner = np.searchsorted(stop, ends)
        gapless = ends - self.sizes[ids] == np.concatenate([[0], ends[:-1]])
        covered = np.bincount(owner, self.sizes[ids], minlength=len(words)) == sizes
        covered[owner[~gapless]] = False
        return ids, owner, covered

    def merge_all(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words: each round merges, in every word that
        still has a mergeable pair, the leftmost of its best ranked pairs.
        Returns token ids and the word of each; words stay in one piece."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.array([self.vocab[s] for w in words for s in w], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_words = [], []
        rank, whole = self._ranks(flat, word)
        while len(flat):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            of = np.cumsum(np.diff(word, prepend=-1) != 0) - 1
            live = (best < NO_RANK)[of]
            if not live.all():
                done_ids.append(flat[~live])
                done_words.append(word[~live])
                flat, word, rank, whole = flat[live], word[live], rank[live], whole[live]
                of = np.cumsum(np.diff(word, prepend=-1) != 0) - 1
                best = best[best < NO_RANK]
            hits = np.flatnonzero(rank == best[of])
            hits = hits[np.diff(of[hits], prepend=-1) != 0]
            flat[hits] = whole[hits]
            keep = np.ones(len(flat), bool)
            keep[hits + 1] = False
            moved = hits - np.arange(len(hits))
            flat, word, rank, whole = flat[keep], word[keep], rank[keep], whole[keep]
            near = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            rank[near], whole[near] = self._ranks(flat, word, near)
        if not done_ids:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(done_ids), np.concatenate(done_words)

    def _ranks(self, flat: np.ndarray, word: np.ndarray, at: np.ndarray | None = None):
        """Rank and result of the pair that begins at each place."""
        if at is None:
            at = np.arange(len(flat))
        after = np.minimum(at + 1, len(flat) - 1)
        code = flat[at] << 32 | flat[after]
        k = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        good = (self.pair_codes[k] == code) & (word[at] == word[after]) & (after > at)
        return np.where(good, self.pair_ranks[k], NO_RANK), np.where(good, self.pair_whole[k], 0)

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each code (left + 1) * 2^32 + right: does the pair stay as it is?
        left 0 stands for a word of one token."""
        codes, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.known, codes)
        at[at == len(self.known)] = 0
        old = self.known[at] == codes if len(self.known) else np.zeros(len(codes), bool)
        good = np.zeros(len(codes), bool)
        good[old] = self.fits[at[old]]
        for k in np.flatnonzero(~old):
            left, right = divmod(int(codes[k]), 1 << 32)
            want = [self.tokens[x] for x in ((left - 1, right) if left else (right,))]
            good[k] = self.merge([s for t in want for s in self.symbols(t)]) == want
        if not old.all():
            if len(self.known) > MAX_CACHED_PAIRS:
                self.known, self.fits = codes, good
            else:
                keys = np.concatenate([self.known, codes[~old]])
                order = np.argsort(keys)
                self.known = keys[order]
                self.fits = np.concatenate([self.fits, good[~old]])[order]
        return good[back]

    def encode_words(self, words: list[str]) -> tuple[bytes, list[int]]:
        """Token ids of the words, one after another as little-endian 32-bit
        integers, and where each word ends: propose, test all pairs, repair."""
        if not words:
            return b"", []
        ids, owner, good = self.propose(words)
        sizes = np.bincount(owner, minlength=len(words))
        inside = owner[1:] == owner[:-1]
        single = sizes[owner] == 1
        codes = np.concatenate([(ids[:-1][inside] + 1 << 32) + ids[1:][inside], ids[single]])
        owners = np.concatenate([owner[1:][inside], owner[single]])
        tested = good[owners]
        good[owners[tested][~self.compatible(codes[tested])]] = False
        failing = np.flatnonzero(~good)
        symbols = [self.symbols(words[k] + self.suffix) for k in failing.tolist()]
        lengths = np.fromiter(map(len, symbols), np.int64, len(symbols))
        short = np.flatnonzero(lengths <= MAX_ROUND_SYMBOLS)
        new_ids, new_words = self.merge_all([symbols[k] for k in short.tolist()])
        parts = [(ids[good[owner]], owner[good[owner]]), (new_ids, failing[short][new_words])]
        for k in np.flatnonzero(lengths > MAX_ROUND_SYMBOLS).tolist():
            found = np.array([self.vocab[t] for t in self.merge(symbols[k])], np.int64)
            parts.append((found, np.full(len(found), failing[k])))
        ids, owner = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(owner, kind="stable")
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(words)))
        return ids[order].astype("<u4").tobytes(), ends.tolist()


def check_supported(spec: dict) -> None:
    """Refuse a file whose rules this module would not follow."""
    model, cut = spec["model"], json.dumps(spec.get("pre_tokenizer"))
    bent = [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    problems = {
        f"model {model['type']}": model["type"] != "BPE",
        "no byte-level symbols": '"ByteLevel"' not in cut,
        "continuing prefix": bool(model.get("continuing_subword_prefix")),
        "dropout": bool(model.get("dropout")),
        "whole words before merges": bool(model.get("ignore_merges")),
        f"added tokens {bent}": bool(bent),
    }
    if found := [p for p, here in problems.items() if here]:
        raise ValueError(f"vocabulary file not supported: {', '.join(found)}")


class Encoder:
    """Whole texts to ids and back, with a bounded cache of words."""

    def __init__(self, text: str, cached_words: int = MAX_CACHED_WORDS):
        from tokenizers import Tokenizer

        self.cached_words = cached_words

        spec = json.loads(text)
        check_supported(spec)
        library = Tokenizer.from_str(text)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.plain = (spec["normalizer"], spec["pre_tokenizer"]) == PLAIN_RULES
        self.merger = Merger(spec)
        del library
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
        )
        # Latin-1 words, and white-space-free pieces of other texts; or, where
        # the library cuts whole texts, its words in byte-level symbols.
        self.words: dict[str, bytes] = {}
        self.symbols: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def cut(self, text: str) -> tuple[dict[str, bytes], list[str]]:
        """The cache that holds a text's pieces, and the pieces."""
        if not self.plain:
            return self.symbols, self.library_words(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if any(c in text for c in _MORE_CUTS):
                return self.chunks, [c for c in _WHITE_SPACE.split(text) if c]
            return self.chunks, text.split()
        return self.words, _PLAIN_WORDS.findall(text.lower())

    def library_words(self, text: str) -> list[str]:
        """A text's words in byte-level symbols, by the file's own rules."""
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        return [w for w, _ in self.splitter.pre_tokenize_str(text)]

    def learn(self, cache: dict[str, bytes], pieces: set[str]) -> None:
        """Fill a cache for these pieces; a cache that would outgrow its bound
        starts anew (it always holds one slice's pieces)."""
        new = [c for c in pieces if c not in cache]
        if len(cache) + len(new) > self.cached_words:
            cache.clear()
            new = list(pieces)
        if not new:
            return
        if cache is not self.chunks:
            words = [
                w
                if cache is self.symbols or w.isascii() and w.isprintable()
                else w.encode().decode("latin-1").translate(_BYTE_SYMBOL)
                for w in new
            ]
            flat, ends = self.merger.encode_words(words)
            at = 0
            for word, end in zip(new, ends):
                cache[word] = flat[at:end]
                at = end
            return
        cut = [self.library_words(c) for c in new]
        words = list({w for ws in cut for w in ws})
        flat, ends = self.merger.encode_words(words)
        found = {w: flat[s:e] for w, s, e in zip(words, [0, *ends], ends)}
        for chunk, ws in zip(new, cut):
            cache[chunk] = b"".join(map(found.__getitem__, ws))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        parts: list[list] = []
        wanted = [(cache, set()) for cache in (self.words, self.chunks, self.symbols)]
        for text in texts:
            special = any(map(text.__contains__, self.special))
            pieces = self.special_cut.split(text) if special else [text]
            part: list = []
            for piece in filter(None, pieces):
                if piece in self.special:
                    part.append((None, np.array([self.special[piece]], "<u4").tobytes()))
                else:
                    cache, words = self.cut(piece)
                    next(known for c, known in wanted if c is cache).update(words)
                    part.append((cache, words))
            parts.append(part)
        for cache, pieces in wanted:
            self.learn(cache, pieces)
        return [
            b"".join(
                words if cache is None else b"".join(map(cache.__getitem__, words))
                for cache, words in part
            )
            for part in parts
        ]


class Decoder:
    """Ids to text: the tokens' names joined by a space, as the library does
    for a file without a decoder; with one, the library decodes."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.library = None
        if spec.get("decoder"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(text)
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        names |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]

    def decode(self, ids: bytes) -> str:
        if self.library:
            return self.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def broadcast_vocabulary(df: DataFrame, tokenizer_path: str):
    """The file's text, for the tasks."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer_path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(text)


def encode(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, ids: the whole text's token ids as little-endian 32-bit integers.

    One output row per input row; null and empty texts have no ids; null or
    repeated row ids and other columns do not matter.
    """
    shared = broadcast_vocabulary(df, tokenizer_path)

    def rows(batch: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
        texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(encoder.encode(texts), pa.binary())], names=["id", "ids"]
        )

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = arrow_pass(
        source, rows, f"id {kind}, ids binary", lambda: Encoder(shared.value), slice_bytes=4 << 20
    )
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """id, ids, decoded: what ``encode`` returned, and its text read back."""
    shared = broadcast_vocabulary(df, tokenizer_path)

    def rows(batch: pa.RecordBatch, decoder: Decoder) -> pa.RecordBatch:
        texts = [decoder.decode(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(texts, pa.string())], names=["id", "ids", "decoded"]
        )

    source = df.select(F.col(id_col).alias("id"), "ids")
    kind = source.schema["id"].dataType.simpleString()
    out = arrow_pass(
        source,
        rows,
        f"id {kind}, ids binary, decoded string",
        lambda: Decoder(shared.value),
        slice_bytes=4 << 20,
    )
    return out.withColumnRenamed("id", id_col)


def round_trip(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``decode(encode(df))`` in one pass, hence one worker a task: id, ids
    and the text decoded from these ids."""
    shared = broadcast_vocabulary(df, tokenizer_path)

    def rows(batch: pa.RecordBatch, both: tuple[Encoder, Decoder]) -> pa.RecordBatch:
        encoder, decoder = both
        ids = encoder.encode(["" if t is None else t for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(ids, pa.binary()),
                pa.array([decoder.decode(x) for x in ids], pa.string()),
            ],
            names=["id", "ids", "decoded"],
        )

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = arrow_pass(
        source,
        rows,
        f"id {kind}, ids binary, decoded string",
        lambda: (Encoder(shared.value), Decoder(shared.value)),
        slice_bytes=4 << 20,
    )
    return out.withColumnRenamed("id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id", more: list[str] = []) -> DataFrame:
    """The contract's columns, and ``more`` of the rows' own."""
    return decoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )
