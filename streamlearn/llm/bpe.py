"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

Method: the distinct words of a block of text are the paths of a trie. Walking it depth first, each node gets one
value: the last token of the encoding of its prefix. A byte-level BPE encoding is the one token sequence whose
neighbours are all compatible, so the last token of a prefix is the one token that ends there and is compatible with
the last token of the prefix before it; prefixes shared by words are thereby encoded once. A word's tokens are read
off by walking back from its last node. Sorted words with their common prefix lengths give the depth-first order,
so only one path of the trie is held at a time. Encodings are kept per worker in a memo of two bounded generations.

The work is linear in a word's length (a merge loop is not), and texts pass in blocks, so a very long text or word
needs memory in proportion to itself only.

Defined results: a null text counts as empty and has no tokens. The special token's string in a text is that token.
Repeated rows, null and repeated doc_ids are encoded row by row. Other columns are dropped.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Pre-tokenisation of byte-level BPE: contractions, letters, numbers, other marks, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words encoded together, and words in each of the two generations of a worker's memo.
BLOCK_WORDS, MEMO_WORDS = 100_000, 150_000
#: Pairs of tokens whose compatibility a worker remembers.
MEMO_PAIRS = 300_000


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, which pairs merge, and which tokens may stand side by side."""

    def __init__(self, spec: dict):
        import ahocorasick
        import regex

        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: raw(s) for s, i in spec["model"]["vocab"].items() if s not in self.special}
        ids = {b: i for i, b in self.bytes.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.single = [ids.get(bytes([b]), -1) for b in range(256)]
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.ids = {b: i for b, i in ids.items() if len(b) == 1 or self.merge(b) == [i]}
        #: Finds the tokens that end at each byte, longest first.
        self.finder = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.finder.add_word(b.decode("latin-1"), (i, len(b)))
        self.finder.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merge(self, data: bytes) -> list[int]:
        """Plain merging, for short strings."""
        parts = [self.single[b] for b in data]
        while len(parts) > 1:
            found = [(m[0], i, m[1]) for i, p in enumerate(zip(parts, parts[1:])) if (m := self.merges.get(p))]
            if not found:
                break
            _, i, token = min(found)
            parts[i : i + 2] = [token]
        return parts

    def side_by_side(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word in order, with its tokens. words: sorted and distinct."""
        find, known, fits = self.finder.iter, self.pairs, self.side_by_side
        path: list[int] = []  # last token of every prefix on the way from the root
        widths: list[int] = []
        before = b""
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del path[shared:], widths[shared:]
            done = shared  # prefixes that have their last token
            for at, (token, n) in find(word.decode("latin-1")):
                if at != done:  # shared, or already settled by a longer token
                    continue
                if n <= at:
                    last = path[at - n]
                    if not (known.get(last << 32 | token) or fits(last, token)):
                        continue
                path.append(token)
                widths.append(n)
                done += 1
            out, at = [], len(word)
            while at:
                out.append(path[at - 1])
                at -= widths[at - 1]
            out.reverse()
            before = word
            yield word, out


class Codec:
    """Encodes and decodes whole texts block by block with a bounded memo."""

    def __init__(self, spec: dict):
        self.v = Vocabulary(spec)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before, from which words still in use come back

    def _blocks(self, text: str) -> Iterator[list[str] | int]:
        """Lists of at most BLOCK_WORDS words, and ids of special tokens."""
        at = 0
        for m in [*(self.v.specials.finditer(text) if self.v.specials else ()), None]:
            piece = text[at : m.start() if m else len(text)]
            if len(piece) < BLOCK_WORDS:
                if piece:
                    yield self.v.words.findall(piece)
            else:
                block: list[str] = []
                for w in self.v.words.finditer(piece):
                    block.append(w.group())
                    if len(block) == BLOCK_WORDS:
                        yield block
                        block = []
                yield block
            if m:
                yield self.v.special[m.group()]
                at = m.end()

    def _learn(self, blocks: Iterable[list[str]]) -> None:
        new = {w for b in blocks for w in b if w not in self.memo}
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.older, self.memo = self.memo, {}
            new = {w for b in blocks for w in b}
        memo, older, by_bytes = self.memo, self.older, {}
        for w in new:
            if (known := older.get(w)) is None:
                by_bytes[w.encode()] = w
            else:
                memo[w] = known
        for raw, ids in self.v.encode_words(sorted(by_bytes)):
            memo[by_bytes[raw]] = array("I", ids).tobytes()

    def texts(self, texts: Iterable[str]) -> Iterator[Iterator[bytes]]:
        """For each text an iterator of its ids as little-endian 32-bit integers, in pieces. Short texts share a trie."""
        waiting: list[list] = []
        n = 0
        for text in texts:
            if len(text) < BLOCK_WORDS:
                blocks = list(self._blocks(text))
                waiting.append(blocks)
                n += sum(len(b) for b in blocks if isinstance(b, list))
                if n < BLOCK_WORDS:
                    continue
                yield from self._flush(waiting)
                waiting, n = [], 0
            else:
                yield from self._flush(waiting)
                waiting, n = [], 0
                yield self._long(text)
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list]) -> Iterator[Iterator[bytes]]:
        self._learn([b for blocks in waiting for b in blocks if isinstance(b, list)])
        for blocks in waiting:
            yield iter([self._ids(b) for b in blocks])

    def _long(self, text: str) -> Iterator[bytes]:
        for b in self._blocks(text):
            if isinstance(b, list):
                self._learn([b])
            yield self._ids(b)

    def _ids(self, block: list[str] | int) -> bytes:
        if isinstance(block, int):
            return block.to_bytes(4, "little")
        return b"".join(map(self.memo.__getitem__, block))

    def encode(self, text: str) -> list[int]:
        import numpy as np

        return np.frombuffer(b"".join(b"".join(x) for x in self.texts([text])), "<u4").tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(content: str) -> Codec:
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(json.loads(content))
    return _CODECS[key]


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document its number of tokens, digests of the ids and of the text decoded from them, and the ids if asked.

    vocabulary: path of a byte-level BPE file in the tokenizers library's format, read by the driver and broadcast
    (its size is fixed by the vocabulary, not by the data).
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = codec(spec.value)
        for batch in batches:
            out: dict[str, list] = {"n": [], "ids": [], "decoded": [], "list": []}
            texts = (x.as_py() for x in batch.column(1))
            for pieces in own.texts(texts):
                n, ids_sha, text_sha, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                utf8 = codecs.getincrementaldecoder("utf-8")("replace")
                for piece in pieces:
                    ids = np.frombuffer(piece, "<u4")
                    n += len(ids)
                    ids_sha.update(piece)
                    text_sha.update(utf8.decode(own.decode_bytes(ids.tolist())).encode())
                    if with_ids:
                        kept.append(ids)
                text_sha.update(utf8.decode(b"", True).encode())
                out["n"].append(n)
                out["ids"].append(ids_sha.hexdigest())
                out["decoded"].append(text_sha.hexdigest())
                out["list"].append(np.concatenate(kept).astype("int32") if kept else np.empty(0, "int32"))
            columns = [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["ids"], pa.string()), pa.array(out["decoded"], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(out["list"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), run, schema)
