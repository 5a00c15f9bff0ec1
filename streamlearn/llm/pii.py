"""Personal data by rules, completed by a skip-chain conditional random field.

Base spans come from fixed rules (email, ip, card, phone) and always stay. The CRF labels a document's candidate
tokens (those with a digit or an at sign) with a kind or none. Its potentials are features of the token and its
neighbours, transitions between candidates that stand side by side, and skip edges from one occurrence of the same
digits (or the same letters), the first in a base span if any is, to every other one in the document, so a number that
is plainly a phone number in one place is found again where its prefix is missing, however far away. Tokens in base
spans have their kind as a known label. Inference is loopy sum-product message passing over the whole document's graph
until nothing changes; messages whose sources have settled are not sent again, and messages are made in blocks, so
memory is some 300 bytes a candidate token, whatever the text's length. Tokens labelled with a marginal of at least
`sure` that touch no base span give the added spans (crf_email, crf_ip, crf_card, crf_phone).

The model is trained here: the base spans of at most `train_docs` whole documents, `train_chars` characters together
(documented bounds, chosen by hash), label its tokens (those outside whose value stands in a base span elsewhere are
left out, as they may be either), each value is repeated without its + and in a form unknown, beside a label that is
known, token features are dropped at random so that the neighbours' and the skip edges' weights are learnt, and the
pseudo-likelihood is maximised. The skip graph of a document is linear in its tokens.

Defined results: a null text counts as empty and has no span. Offsets are code points, ends exclusive. Repeated rows
are scanned row by row; without training rows nothing is added. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Taken, map_arrow, training_texts

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
ADDED = tuple(f"crf_{k}" for k in KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a start inside digits can only repeat the failure at their beginning
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>"
FEATURES, LABELS = 1 << 12, 5
#: Features of a token; messages made at once.
PER_TOKEN, BLOCK_MESSAGES = 10, 1 << 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    small = lambda part: len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]], names: tuple[str, ...]) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)


def _shape(token: str) -> str:
    out = []
    for c in token[:40]:
        s = "9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c
        if not out or out[-1] != s or not s.isalnum():
            out.append(s)
    return "".join(out)


def _features(core: str, raw: str, before: str, after: str) -> list[int]:
    import xxhash

    digits = _digits(core)
    names = [
        "bias", f"shape={_shape(core)}", f"digits={min(len(digits), 20)}", f"at={'@' in core}", f"dots={min(core.count('.'), 4)}",
        f"plus={raw.startswith('+')}", f"luhn={len(digits) >= 13 and luhn(digits)}", f"letters={any(c.isalpha() for c in core)}",
        f"before={_shape(before) if _DIGIT.search(before) else before[-12:]}", f"after={_shape(after) if _DIGIT.search(after) else after[:12]}",
    ]
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names]


class Document:
    """Candidate tokens of a text: spans, features, and the edges of the graph, all in typed arrays."""

    def __init__(self, text: str, with_words: bool = False):
        import numpy as np
        import xxhash

        self.starts, self.ends = array("q"), array("q")
        self.words: list[tuple[str, str, str, str]] = []
        features, follows, keys, tells = array("H"), array("b"), array("Q"), array("b")
        before, adjacent = "^", False
        for m, after in pairwise(chain(_TOKEN.finditer(text), [None])):
            raw, (left, right) = m.group(), m.span()
            core = ""
            if _DIGIT.search(raw) or "@" in raw:
                core = raw.strip(_EDGE)
                left += len(raw) - len(raw.lstrip(_EDGE))
            if not core:
                before, adjacent = raw, False
                continue
            told = after.group() if after else "$"
            self.starts.append(left)
            self.ends.append(left + len(core))
            features.extend(_features(core, raw, before.lower(), told.lower()))
            if with_words:
                self.words.append((core, raw, before.lower(), told.lower()))
            follows.append(adjacent)
            digits = _digits(core)
            keys.append(xxhash.xxh64_intdigest((f"#{digits}" if len(digits) >= 6 else core.lower()).encode("utf-8", "surrogatepass")))
            tells.append(len(digits) >= 6 or "@" in core)
            before, adjacent = raw, True
        n = len(self.starts)
        self.features = np.frombuffer(features, "u2").reshape(n, PER_TOKEN) if n else np.empty((0, PER_TOKEN), "u2")
        self.tells = np.array(tells, bool)
        second = np.flatnonzero(np.array(follows, bool))
        self.chain = np.stack([second - 1, second], axis=1).astype("i4")
        _, first, group = np.unique(np.array(keys, "u8"), return_index=True, return_inverse=True)
        hub = first[group] if n else np.empty(0, "i8")
        later = np.flatnonzero(hub != np.arange(n))
        self.skip = np.stack([hub[later], later], axis=1).astype("i4")

    @property
    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def hang(self, labels) -> None:
        """Hang the skip edges of a value on its first labelled occurrence, so that all hear of it directly.

        Values that many things share (fewer than six digits and no at sign) lose theirs.
        """
        import numpy as np

        self.skip = self.skip[self.tells[self.skip[:, 0]]]
        hub, who = self.skip[:, 0], self.skip[:, 1]
        n = len(self.starts)
        best = np.full(n, n, "i8")
        told = (labels[who] > 0) & (labels[hub] == 0)
        np.minimum.at(best, hub[told], who[told])
        moved = best[hub] < n
        new = np.where(moved, best[hub], hub)
        self.skip = np.stack([new, np.where(who == new, hub, who)], axis=1).astype("i4")


def _labels(doc: Document, spans: list[tuple[int, int, int]]):
    """0 for none, else 1 + kind of the base span that overlaps a token."""
    import numpy as np

    out = np.zeros(len(doc.starts), "i8")
    for k, a, b in spans:
        n = bisect_right(doc.ends, a)
        while n < len(out) and doc.starts[n] < b:
            out[n] = out[n] or k + 1
            n += 1
    return out


def _unsure(doc: Document, labels):
    """Tokens outside base spans whose value stands in a base span elsewhere."""
    import numpy as np

    hub = np.arange(len(labels))
    hub[doc.skip[:, 1]] = doc.skip[:, 0]
    held = np.zeros(len(labels), bool)
    held[hub[labels > 0]] = True
    return held[hub] & (labels == 0)


class Model:
    """Weights: unary (feature, label), transition and skip (label, label)."""

    def __init__(self, unary, transition, skip):
        self.unary, self.transition, self.skip = unary, transition, skip

    @staticmethod
    def train(texts: list[str], *, epochs: int = 60, rate: float = 0.5, drop: float = 0.5, decay: float = 1e-4, seed: int = 7) -> Model:
        """Pseudo-likelihood: each token given its features (half of them hidden) and its neighbours' labels."""
        import numpy as np

        rows, ys, used, neighbours, at = [], [], [], [], 0
        for text in texts:
            doc = Document(text, with_words=True)
            if not len(doc.starts):
                continue
            y = _labels(doc, base_spans(text))
            doc.hang(y)
            use = ~_unsure(doc, y)
            rows.append(doc.features)
            ys.append(y)
            used.append(use)
            # (token, label beside, which table, direction)
            for table, edges in ((0, doc.chain), (1, doc.skip)):
                for a, b in edges.tolist():
                    neighbours += [(at + i, y[j], table, way) for i, j, way in ((a, b, 0), (b, a, 1)) if use[j]]
            at += len(y)
            # each value that tells is repeated without its +, and in a form unknown, as few texts do so by themselves
            again = np.flatnonzero(doc.tells & use)
            for k in again.tolist():
                core, raw, *beside = doc.words[k]
                rows.append(np.array([_features(core.lstrip("+"), raw.lstrip("+"), *beside), [FEATURES - 1] * PER_TOKEN], "u2"))
                neighbours += [(at + i, y[k], 1, way) for i in range(2) for way in range(2)]
                at += 2
            ys.append(np.repeat(y[again], 2))
            used.append(np.repeat(use[again], 2))
        unary, pair = np.zeros((FEATURES, LABELS)), np.zeros((2, LABELS, LABELS))
        if not rows:
            return Model(unary, pair[0], pair[1])
        x, y = np.concatenate(rows), np.concatenate(ys)
        n = np.array(neighbours, "i8").reshape(-1, 4)
        rnd, total = np.random.default_rng(seed), len(y)
        use = np.concatenate(used)
        weight = use / np.maximum(np.bincount(y[use], minlength=LABELS), 1)[y]
        weight /= weight.sum()
        for _ in range(epochs):
            seen = rnd.random(x.shape) > drop
            score = sum(unary[x[:, j]] * seen[:, j, None] for j in range(PER_TOKEN))
            first = n[:, 3] == 0
            extra = np.where(first[:, None], pair[n[:, 2], :, n[:, 1]], pair[n[:, 2], n[:, 1], :])
            np.add.at(score, n[:, 0], extra)
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = -p
            g[np.arange(total), y] += 1
            g *= weight[:, None] * LABELS
            up = np.zeros_like(unary)
            for j in range(PER_TOKEN):
                np.add.at(up, x[:, j], g * seen[:, j, None])
            side = np.zeros_like(pair)
            np.add.at(side, (n[first, 2], slice(None), n[first, 1]), g[n[first, 0]])
            np.add.at(side, (n[~first, 2], n[~first, 1]), g[n[~first, 0]])
            unary += rate * 20 * (up - decay * unary)
            pair += rate * 20 * (side - decay * pair)
        return Model(unary, pair[0], (pair[1] + pair[1].T) / 2)

    def marginals(self, doc: Document, rounds: int = 500, damping: float = 0.3, known=None, close: float = 1e-7):
        """Loopy belief propagation over chain and skip edges until messages change by less than `close`; known: labels, 0 where open."""
        import numpy as np

        belief = np.zeros((len(doc.starts), LABELS))
        for j in range(PER_TOKEN):
            belief += self.unary[doc.features[:, j]]
        if known is not None and known.any():
            sure = np.flatnonzero(known)
            belief[sure] = -1e3
            belief[sure, known[sure]] = 0.0
        edges, cut = np.concatenate([doc.chain, doc.skip]), len(doc.chain)
        n = len(edges)
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        tables = np.stack([self.transition, self.transition.T, self.skip, self.skip.T])  # (from, to)
        log_m, active = np.zeros((2 * n, LABELS)), np.arange(2 * n)
        for _ in range(rounds):
            if not len(active):
                break
            moved, own = np.zeros(len(belief), bool), np.zeros(2 * n, bool)
            for k in range(0, len(active), BLOCK_MESSAGES):
                m = active[k : k + BLOCK_MESSAGES]
                out = belief[src[m]] - log_m[(m + n) % (2 * n)]
                out = out[:, :, None] + tables[2 * (m % n >= cut) + (m >= n)]
                top = out.max(axis=1, keepdims=True)
                new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                new -= new.max(axis=1, keepdims=True)
                change = (1 - damping) * (new - log_m[m])
                log_m[m] += change
                np.add.at(belief, dst[m], change)
                big = np.abs(change).max(axis=1) >= close
                own[m[big]] = True
                moved[dst[m[big]]] = True
            active = np.flatnonzero(own | moved[src])
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], model: Model, sure: float) -> list[tuple[int, int, int]]:
    """(4 + kind, start, end) of what the CRF finds beside the base spans."""
    import numpy as np

    if not (_DIGIT.search(text) or "@" in text):
        return []
    doc = Document(text)
    if not len(doc.starts):
        return []
    known = _labels(doc, base)
    doc.hang(known)
    p = model.marginals(doc, known=known)
    label = p.argmax(axis=1)
    taken = Taken([(a, b) for _, a, b in base])
    out: list[tuple[int, int, int]] = []
    last = -2
    for n in np.flatnonzero((label > 0) & (p.max(axis=1) >= sure)).tolist():
        a, b, kind = doc.starts[n], doc.ends[n], len(KINDS) + int(label[n]) - 1
        if taken.free(a, b):
            if out and last == n - 1 and out[-1][0] == kind and text[out[-1][2] : a].strip(" ()") == "":
                out[-1] = (kind, out[-1][1], b)
            else:
                out.append((kind, a, b))
            last = n
    return sorted(out)


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", train_docs: int = 4000, train_chars: int = 8_000_000, sure: float = 0.98) -> DataFrame:
    """Spans of personal data of every whole text, as digests and as a list."""
    texts = training_texts(docs, doc_id, text, rows=train_docs, chars=train_chars, holding="[0-9@]")
    model = docs.sparkSession.sparkContext.broadcast(Model.train(texts))

    def run(batches):
        import pyarrow as pa

        names = KINDS + ADDED
        for batch in batches:
            out: list[tuple] = []
            for t in batch.column(1):
                s = t.as_py()
                base = base_spans(s)
                more = added_spans(s, base, model.value, sure)
                counts = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(joined(base, names).encode()).hexdigest(), joined(base + more, names), len(more)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array([r[c] for r in out], kind) for c, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return map_arrow(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), run, SCHEMA)
