"""BPE encoding, decoding and token counts for public tokenizer files (``tokenizers`` JSON).

Encoding merges with a segment tree over the ranks of adjacent pairs: the root holds the
leftmost pair of lowest rank, a merge updates a few leaves, and encoding ends when the
root holds no mergeable pair.  Counting keeps a heap of pairs and a linked list instead,
never forms identifiers, and returns initial symbols minus merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Entries in a generation of a worker's memory of short pieces.
CACHE = 250_000
#: Pieces longer than this are never remembered.
LONG = 64
NEVER = 1 << 60


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in kept else chr(256 + extra))
        extra += b not in kept
    return out


def segment_merge(ids: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """``ids`` after all merges; ``ranks``: (left << 32 | right) to rank; ``merged``: rank to the new id."""
    n = len(ids)
    if n < 2:
        return ids
    get = ranks.get
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    # leaf i: rank of the pair that starts at i, with i in the low bits, so that the least is the leftmost of lowest rank
    shift = width.bit_length()
    end, mask = NEVER << shift, (1 << shift) - 1
    tree = [end] * (2 * width)
    a, i = ids[0], width
    for b in ids[1:]:
        if (rank := get(a << 32 | b)) is not None:
            tree[i] = rank << shift | i - width
        a = b
        i += 1
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    root = tree[1]
    if root >= end:
        return ids
    right, left = [*range(1, n + 1)], [*range(-1, n - 1)]
    while root < end:
        i = root & mask
        j = right[i]
        new = ids[i] = merged[root >> shift]
        ids[j] = -1
        k = right[i] = right[j]
        changed = [(width + i, end)]
        if j < n - 1:
            changed.append((width + j, end))
        if k < n:
            left[k] = i
            if (rank := get(new << 32 | ids[k])) is not None:
                changed[0] = (width + i, rank << shift | i)
        h = left[i]
        if h >= 0:
            rank = get(ids[h] << 32 | new)
            changed.append((width + h, end if rank is None else rank << shift | h))
        for at, value in changed:
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
        root = tree[1]
    return [x for x in ids if x >= 0]


class RankTable:
    """Ranks of adjacent pairs for arrays of pairs: an open hash table."""

    def __init__(self, ranks: dict[int, int]):
        self.bits = max(8, (4 * len(ranks)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.full(len(self.keys), -1, np.int64)
        for key, rank in ranks.items():
            h = key * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - self.bits
            while self.keys[h] >= 0:
                h += 1
            self.keys[h], self.values[h] = key, rank

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where the pair never merges or an end is -1."""
        key = np.where((left < 0) | (right < 0), np.int64(1 << 62), left << 32 | right)
        at = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], -1)
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            at[rest] += 1
            found = self.keys[at[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


def segment_merge_many(words: list[list[int]], table: RankTable, merged: np.ndarray) -> list[list[int]]:
    """``segment_merge`` of words of under 64 symbols, one tree a row of an array, all rows a merge at a time."""
    out: list = [None] * len(words)
    by_width: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_width.setdefault(1 << max(1, len(w).bit_length()), []).append(k)
    for width, which in by_width.items():
        # the last place stands for "no neighbour"; no word reaches it
        none, shift = width - 1, width.bit_length()
        end, mask = np.int64(NEVER), np.int64((1 << shift) - 1)
        rows = np.arange(len(which))
        ids = np.full((len(which), width), -1, np.int64)
        sizes = np.array([len(words[k]) for k in which])
        ids[np.repeat(rows, sizes), np.concatenate([np.arange(n) for n in sizes])] = np.concatenate([words[k] for k in which])
        place = np.arange(width)
        right = np.where(place + 1 < sizes[:, None], place + 1, none)
        left = np.where(place > 0, place - 1, none) + np.zeros_like(right)
        tree = np.full((len(which), 2 * width), end)
        rank = table(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(which), width - 1)
        tree[:, width:-1] = np.where(rank < 0, end, rank << shift | place[:-1])
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        # the arrays as one row each: places of a word's row are counted from its own start
        flat, at, to_left, to_right = tree.ravel(), ids.ravel(), left.ravel(), right.ravel()
        own, top = rows * width, rows * (2 * width)
        while True:
            root = flat[top + 1]
            alive = root < end
            if not alive.all():
                own, top, root = own[alive], top[alive], root[alive]
            if not len(own):
                break
            i = root & mask
            j, h = to_right[own + i], to_left[own + i]
            k = to_right[own + j]
            new = merged[root >> shift]
            at[own + i], at[own + j], to_right[own + i] = new, -1, k
            to_left[own + k] = i
            after, before = table(new, at[own + k]), table(at[own + h], new)
            node = [top + width + j, top + width + i, top + width + h]
            flat[node[0]] = end
            flat[node[1]] = np.where(after < 0, end, after << shift | i)
            flat[node[2]] = np.where(before < 0, end, before << shift | h)
            up = [width + j, width + i, width + h]
            for _ in range(shift - 1):  # from the leaves to the root
                up = [x >> 1 for x in up]
                for x in up:
                    child = top + 2 * x
                    flat[top + x] = np.minimum(flat[child], flat[child + 1])
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        start = 0
        for k, stop in zip(which, ends):
            out[k] = flat[start:stop]
            start = stop
    return out


def heap_count(ids: list[int], ranks: dict[int, int], merged: list[int]) -> int:
    """Number of symbols left after all merges: initial symbols minus merges."""
    n = left_over = len(ids)
    get = ranks.get
    # an entry is rank << 32 | position: the heap gives the leftmost pair of lowest rank
    heap = []
    for i in range(n - 1):
        if (rank := get(ids[i] << 32 | ids[i + 1])) is not None:
            heap.append(rank << 32 | i)
    if not heap:
        return n
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    right, left = [*range(1, n + 1)], [*range(-1, n - 1)]
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFF
        j = right[i]
        if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != top >> 32:
            continue  # one end has changed since
        new = ids[i] = merged[top >> 32]
        ids[j] = -1
        left_over -= 1
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (rank := get(new << 32 | ids[k])) is not None:
                push(heap, rank << 32 | i)
        h = left[i]
        if h >= 0 and (rank := get(ids[h] << 32 | new)) is not None:
            push(heap, rank << 32 | h)
    return left_over


class Bounded(dict):
    """A memory of ``make(key)``: two generations of ``most`` entries, the older one dropped when the newer is full."""

    def __init__(self, make, most: int = CACHE):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


#: White space as the library's patterns see it (not the file separators that str.split() takes as well).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Capitals newer than Python's own tables, which the library lowers.
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)}}


def char_class(kind: str) -> str:
    """Ranges of the characters whose general category starts with ``kind``, for a class of ``re``."""
    out, start = [], None
    for c in range(0x110001):
        inside = c < 0x110000 and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def odd_blank(text: str) -> bool:
    """Whether str.split() would split where the patterns don't."""
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


BYTE_PATTERN = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
BLANKS_AS_ONE = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}


def refuse_unknown(spec: dict) -> None:
    """Raise on anything in a tokenizer file that ``Tokenizer`` doesn't do as the library does."""
    model, odd = spec["model"], []
    odd += [f"model {model['type']}"] * (model["type"] != "BPE")
    odd += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    normal = spec.get("normalizer")
    steps = [] if normal is None else normal.get("normalizers", [normal])
    odd += [f"normalizer {x}" for x in steps if x["type"] not in ("NFC", "Lowercase") and x != BLANKS_AS_ONE]
    pre = spec["pre_tokenizer"]
    split = pre.get("pretokenizers", [{}, {}])
    words = [{k: v for k, v in split[0].items() if k != "pattern"}, *split[1:]]
    if pre != BYTE_PATTERN and words != [{"type": "Split", "behavior": "Removed", "invert": True}, BYTE_PATTERN | {"use_regex": False}]:
        odd.append(f"pre_tokenizer {pre}")
    odd += [f"added token {t['content']}" for t in spec.get("added_tokens") or [] if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    odd += [k for k in ("post_processor",) if spec.get(k)]
    if odd:
        raise ValueError("tokenizer file with unsupported parts: " + "; ".join(odd))


class Tokenizer:
    """A BPE file of the ``tokenizers`` library with byte-level symbols.

    Supports what the public files use: NFC, blank folding and lower case as normalisers,
    a split pattern or the byte-level one, an optional word-end suffix, and added tokens,
    which are matched in the raw text as the library does by default.  Decoding is that of a
    file without a decoder.  Anything else is refused.
    """

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        refuse_unknown(spec)
        model = spec["model"]
        self.decodes = spec.get("decoder") is None
        self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.merged.append(self.vocab[a + b])
        self.byte_ids = [self.vocab[c] for c in byte_chars()]
        self.last_ids = [self.vocab[c + self.suffix] for c in byte_chars()]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.tokens.update({i: t for t, i in self.added.items()})
        self.decimals = {i: str(i) for i in self.tokens}
        self.split_added = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        normal = spec.get("normalizer")
        kinds = [] if normal is None else [x["type"] for x in normal.get("normalizers", [normal])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pre = spec["pre_tokenizer"]
        self.words_only = pre["type"] == "Sequence"
        letter, number = char_class("L"), char_class("N")
        if self.words_only:
            pattern = pre["pretokenizers"][0]["pattern"]["Regex"].replace("[\\p{L}]", f"[{letter}]").replace("[\\p{N}]", f"[{number}]")
        else:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|[\s]+(?![^\s])|[\s]+".replace(" ?\\p{L}+", f" ?[{letter}]+").replace(" ?\\p{N}+", f" ?[{number}]+")
        self.pattern = re.compile(pattern.replace("\\p{L}", letter).replace("\\p{N}", number).replace("\\s", SPACE))
        self.table = None
        self.next_to_blank = re.compile(f"[{SPACE}] | [{SPACE}]|[{SPACE}]\n|\n[{SPACE}]")
        self.ids_of_word = Bounded(lambda w: tuple(self._word_ids(w)))
        self.chunk = Bounded(self._chunk, CACHE // 2)
        self.count_of_word = Bounded(self._word_count)
        self.count_first = Bounded(lambda s: sum(map(self.count_of_word.__getitem__, self.pattern.findall(s))))
        self.count_next = Bounded(lambda s: sum(map(self.count_of_word.__getitem__, self.pattern.findall(" " + s))))

    def symbols(self, word: str) -> list[int]:
        if self.suffix and word:
            *rest, last = word.encode("utf-8", "surrogatepass")
            return [*map(self.byte_ids.__getitem__, rest), self.last_ids[last]]
        return [*map(self.byte_ids.__getitem__, word.encode("utf-8", "surrogatepass"))]

    def _word_ids(self, word: str) -> list[int]:
        return segment_merge(self.symbols(word), self.ranks, self.merged)

    def _word_count(self, word: str) -> int:
        return heap_count(self.symbols(word), self.ranks, self.merged)

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Of a piece without white space: decimal ids and token strings, each joined by a blank."""
        return self._joined_words(self.pattern.findall(chunk))

    def _joined_words(self, words: list[str]) -> tuple[str, str]:
        ids = self.ids_of_word[words[0]] if len(words) == 1 else [i for w in words for i in self.ids_of_word[w]]
        return " ".join(map(self.decimals.__getitem__, ids)), " ".join(map(self.tokens.__getitem__, ids))

    def _normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # the library lowers one character at a time, so a final sigma isn't special
            text = text.replace("Σ", "σ").lower()
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                text = text.translate(NEW_CAPITALS)
        return text

    def warm(self, texts: list[str], strings: bool = False) -> None:
        """Encode the words of ``texts`` that aren't remembered, many at a time; ``strings``: and join their ids and tokens."""
        if self.table is None:
            self.table, self.merged_array = RankTable(self.ranks), np.array(self.merged, np.int64)
        chunks: set[str] = set()
        for t in texts:
            chunks.update(self._normal(t).split())
        known, find = self.ids_of_word, self.pattern.findall
        fresh = [(c, find(c)) for c in chunks if c not in self.chunk and c not in self.chunk.old]
        new = [w for w in {w for _, ws in fresh for w in ws} if 1 < len(w) <= LONG // 2 and w not in known and w not in known.old]
        symbols = [self.symbols(w) for w in new]
        short = [k for k, x in enumerate(symbols) if len(x) < LONG]
        for k, ids in zip(short, segment_merge_many([symbols[k] for k in short], self.table, self.merged_array)):
            known.put(new[k], tuple(ids))
        if strings and self.words_only:
            for c, ws in fresh:
                if len(c) <= LONG:
                    self.chunk.put(c, self._joined_words(ws))

    def _segments(self, text: str) -> list[str]:
        """Ordinary text at even places, added tokens at odd ones."""
        return self.split_added.split(text) if self.split_added and any(a in text for a in self.added) else [text]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self._segments(text)):
            if k % 2:
                out.append(self.added[part])
            else:
                for w in self.pattern.findall(self._normal(part)):
                    out += self.ids_of_word[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a blank, as the library does for a file without a decoder."""
        if not self.decodes:
            raise ValueError("a file with a decoder is encoded and counted only")
        return " ".join(map(self.tokens.__getitem__, ids))

    def joined(self, text: str) -> tuple[str, str]:
        """``" ".join`` of the ids and of the tokens, without lists of either."""
        ids, tokens = [], []
        for k, part in enumerate(self._segments(text)):
            if k % 2:
                ids.append(str(self.added[part]))
                tokens.append(part)
                continue
            part = self._normal(part)
            if self.words_only and not odd_blank(part):
                pieces = map(self.chunk.__getitem__, part.split())
            else:
                pieces = [self._joined_words([w]) for w in self.pattern.findall(part)]
            for i, t in pieces:
                ids.append(i)
                tokens.append(t)
        return " ".join(ids), " ".join(tokens)

    def count(self, text: str) -> int:
        n = 0
        for k, part in enumerate(self._segments(text)):
            if k % 2:
                n += 1
                continue
            part = self._normal(part)
            if self.words_only:
                n += sum(map(self.count_of_word.__getitem__, self.pattern.findall(part)))
            elif self.next_to_blank.search(part) or odd_blank(part):
                n += sum(map(self.count_of_word.__getitem__, self.pattern.findall(part)))
            else:  # each blank belongs to the word after it, each line feed stands alone
                lines = part.split("\n")
                n += (len(lines) - 1) * self.count_of_word["\n"]
                for line in lines:
                    first, *rest = line.split(" ")
                    n += self.count_first[first] + sum(map(self.count_next.__getitem__, rest))
        return n


def runs(texts: pa.Array, most: int = 4_000_000):
    """The texts, null as empty, in lists of about ``most`` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    yield held


def worker_tokenizer(key: str, raw: bytes) -> Tokenizer:
    """One tokenizer a Python worker; it outlives tasks."""
    held = sys.__dict__.setdefault("_gristmill_tokenizers", {})
    if key not in held:
        held.clear()
        held[key] = Tokenizer(raw)
    return held[key]


def _shipped(spark: SparkSession, path: str):
    """The whole vocabulary file to the executors, which need no copy of their own; its size doesn't grow with the documents."""
    with open(path, "rb") as f:
        raw = f.read()
    return hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)``: every whole text encoded; null and empty texts give no ids.

    Repeated rows and null ids stay as they are; other columns are not read.
    """
    key, raw = _shipped(docs.sparkSession, path)

    def run(batches):
        tok = worker_tokenizer(key, raw.value)
        for b in batches:
            ids = []
            for texts in runs(b.column(1)):
                tok.warm(texts)
                ids += map(tok.encode, texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    src = docs.select(docs[id_col].cast("long").alias("k"), docs[text_col].alias("t"))
    return src.mapInArrow(run, "k long, ids array<int>").withColumnRenamed("k", id_col)


def encode_rows(docs: DataFrame, path: str, keep=("doc_id", "lang", "source"), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, with ``n_tokens``, ``ids array<int>`` and ``decoded_sha256``, the digest of the decoded ids."""
    key, raw = _shipped(docs.sparkSession, path)
    src = docs.select(*[docs[c] for c in keep], docs[text_col].alias("t"))
    n = len(keep)

    def run(batches):
        tok = worker_tokenizer(key, raw.value)
        for b in batches:
            start = 0
            for texts in runs(b.column(n)):
                tok.warm(texts)
                ids = [*map(tok.encode, texts)]
                digests = [hashlib.sha256(tok.decode(x).encode()).hexdigest() for x in ids]
                part = [b.column(i).slice(start, len(texts)) for i in range(n)]
                start += len(texts)
                yield pa.RecordBatch.from_arrays([*part, pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(digests, pa.string())], [*keep, "n_tokens", "ids", "decoded_sha256"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n])
    return src.mapInArrow(run, f"{fields}, n_tokens long, ids array<int>, decoded_sha256 string")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded string)``; null lists decode to an empty string."""
    key, raw = _shipped(encoded.sparkSession, path)

    def run(batches):
        tok = worker_tokenizer(key, raw.value)
        for b in batches:
            out = [tok.decode(x.as_py() or []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["k", "decoded"])

    src = encoded.select(encoded[id_col].cast("long").alias("k"), encoded[ids_col].alias("i"))
    return src.mapInArrow(run, "k long, decoded string").withColumnRenamed("k", id_col)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encoding and decoding in one pass over the texts.

    Null and empty texts: no tokens, digests of the empty string.
    """
    key, raw = _shipped(docs.sparkSession, path)
    schema = "k long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        tok = worker_tokenizer(key, raw.value)
        for b in batches:
            ns, ids, outs = [], [], []
            for texts in runs(b.column(1)):
                tok.warm(texts, strings=True)
                for t in texts:
                    i, d = tok.joined(t)
                    ns.append(i.count(" ") + 1 if i else 0)
                    ids.append(hashlib.sha256(i.encode()).hexdigest())
                    outs.append(hashlib.sha256(d.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(ids, pa.string()), pa.array(outs, pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(docs[id_col].cast("long").alias("k"), docs[text_col].alias("t"))
    return src.mapInArrow(run, schema).withColumnRenamed("k", id_col)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every whole text; null counts as empty."""
    key, raw = _shipped(docs.sparkSession, path)
    schema = "k long, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches):
        tok = worker_tokenizer(key, raw.value)
        for b in batches:
            sizes, ns = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                sizes.append(len(text.encode()))
                ns.append(tok.count(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ns, pa.int64()), pa.array([n > limit for n in ns], pa.bool_())], ["k", "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(docs[id_col].cast("long").alias("k"), docs[text_col].alias("t"))
    return src.mapInArrow(run, schema).withColumnRenamed("k", id_col)
