"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoding: whether two neighbouring symbols end up merged depends only on a bounded number of symbols to the
right, because a merge can only be pre-empted by a merge of lower rank, that one by one of still lower rank, and
so on. ``sufficient_lookahead`` computes that bound from the merge list; ``MergeTransducer`` emits a token as soon
as it is that far behind the input, so a run of any length is encoded in constant memory. Decoding: ``Decoder`` is
an incremental state machine from ids to text; it holds at most an unfinished UTF-8 sequence.

Defined results: a null text is an empty one (no tokens); equal texts get equal rows; further columns of the
input are not read and names cannot clash, as only ``doc_id`` and ``text`` are selected.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Texts are taken in pieces of about so many characters, cut at white space.
PIECE = 1 << 16
#: A whitespace-free run longer than this is not cached, and goes through the transducer.
RUN = 256
_NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 upwards."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Bpe:
    """A tokenizer file of the ``tokenizers`` library: byte-level BPE, with or without an end-of-word suffix."""

    def __init__(self, path: str, split: str | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.longest = max((self._size(a + b) for a, b in pairs), default=1)
        self.letters = byte_alphabet()
        self.bytes_of = {c: i for i, c in enumerate(self.letters)}
        self.word_ids = Cached(self._word, 500_000)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_re = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        steps = spec.get("normalizer") or {}
        self.kinds = {x["type"] for x in steps.get("normalizers", [steps] if steps else [])}
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [pre])
        given = next((x["pattern"]["Regex"] for x in parts if x.get("type") == "Split"), None)
        own = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.drops_space = given is not None
        self.pretoken = regex.compile((split or given or own).replace(r"^\s", r"^\p{White_Space}").replace(r"\s", r"\p{White_Space}") if given else own)
        self.byte_level_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.whole = all(x in self.vocab and x + self.suffix in self.vocab for x in self.letters)

    @functools.cached_property
    def lookahead(self) -> int:
        """Found when a word is long enough for the transducer."""
        return sufficient_lookahead([*self.ranks], self.suffix)

    def _size(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def normal(self, text: str) -> str:
        if "NFC" in self.kinds and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if "Lowercase" in self.kinds:
            # Character by character: the final form of sigma depends on its neighbours in str.lower().
            text = text.replace("Σ", "σ").lower()
        return text

    def symbols(self, word: str) -> list[str]:
        return [self.letters[b] for b in word.encode("utf-8")]

    def merged(self, parts: list[str]) -> list[str]:
        """Merges the pair of lowest rank, the leftmost first, until none is left."""
        if len(parts) > 48:
            return self._merged_long(parts)
        get = self.ranks.get
        found = [get(x, _NEVER) for x in zip(parts, parts[1:])]
        while found and (low := min(found)) < _NEVER:
            at = found.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = get((parts[at - 1], parts[at]), _NEVER)
            if at < len(found):
                found[at] = get((parts[at], parts[at + 1]), _NEVER)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same by a heap of (rank, place) over a linked list: n log n."""
        get, n = self.ranks.get, len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, k) for k, pair in enumerate(zip(parts, parts[1:])) if (r := get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if not alive[k] or (j := after[k]) < 0 or get((parts[k], parts[j])) != r:
                continue
            parts[k] += parts[j]
            alive[j] = False
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
                if (x := get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (x, k))
            if before[k] >= 0 and (x := get((parts[before[k]], parts[k]))) is not None:
                heapq.heappush(heap, (x, before[k]))
        return [p for p, a in zip(parts, alive) if a]

    def _word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        if len(word) > RUN:
            t = MergeTransducer(self)
            return [*t.push(self.symbols(word)), *t.end()]
        parts = self.symbols(word)
        if parts and self.suffix:
            parts[-1] += self.suffix
        return [self.vocab[x] for x in self.merged(parts) if x in self.vocab]

    def plain(self, text: str) -> Iterator[int]:
        """The ids of a text without special tokens."""
        text = self.normal(text)
        if self.drops_space and text.isascii() and text.isalpha():
            yield from self.word_ids[text]
            return
        for m in self.pretoken.finditer(text):
            yield from self.word_ids[m[0]]

    def run(self, text: str) -> list[int]:
        """The ids of any text, special tokens included."""
        if not self.special_re or not any(x in text for x in self.special):
            return [*self.plain(text)]
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [*self.plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return [*out, *self.plain(text[at:])]

    def odd(self, text: str) -> bool:
        """Whether a text has to be taken as it is, not by its white-space runs."""
        return not self.drops_space or any(c in text for c in "\x1c\x1d\x1e\x1f") or any(x in text for x in self.special)

    def pieces(self, text: str) -> Iterator[str | list[str]]:
        """White-space runs of a text, some thousands at a time; or a str that has to be taken as it is."""
        if self.odd(text):
            yield text
            return
        a = 0
        while a < len(text):
            b = min(len(text), a + PIECE)
            while b < len(text) and not text[b].isspace():
                b += 1
            yield text[a:b].split()
            a = b


def sufficient_lookahead(pairs: list[tuple[str, str]], suffix: str) -> int:
    """Symbols to the right that can decide whether a merge happens.

    Merge r = (a, b) at a boundary needs the end of b to be a boundary when rank r is reached. A merge q < r
    removes that boundary only if its left part ends like b: one is a suffix of the other. So
    reach(r) = len(b) + max(0, reach(q) for such q < r), computed in rank order over suffix-keyed maxima.
    """
    size = (lambda t: len(t.removesuffix(suffix))) if suffix else len
    exact: dict[str, int] = {}  # left part -> largest reach
    below: dict[str, int] = {}  # every suffix of a left part -> largest reach
    most = 1
    for a, b in pairs:
        reach = below.get(b, 0)
        for i in range(1, len(b)):
            reach = max(reach, exact.get(b[i:], 0))
        reach += size(b)
        most = max(most, reach)
        exact[a] = max(exact.get(a, 0), reach)
        for i in range(len(a)):
            if below.get(a[i:], 0) < reach:
                below[a[i:]] = reach
    return most + 1


class MergeTransducer:
    """Encodes one pre-token that arrives in pieces; holds at most lookahead + longest token + STEP symbols."""

    STEP = 512

    def __init__(self, bpe: Bpe):
        self.bpe, self.held = bpe, []

    def push(self, symbols: list[str]) -> Iterator[int]:
        b = self.bpe
        room = b.lookahead + b.longest + self.STEP
        for i in range(0, len(symbols), self.STEP):
            self.held += symbols[i : i + self.STEP]
            if len(self.held) >= room:
                yield from self._emit(len(self.held) - b.lookahead)

    def _emit(self, stable: int) -> Iterator[int]:
        """Emits the tokens that end at a boundary no later input can remove."""
        at = 0
        for token in self.bpe.merged([*self.held]):
            if at + len(token) > stable:
                break
            at += len(token)
            if token in self.bpe.vocab:
                yield self.bpe.vocab[token]
        self.held = self.held[at:]

    def end(self) -> Iterator[int]:
        parts, self.held = self.held, []
        if parts and self.bpe.suffix:
            parts[-1] += self.bpe.suffix
        for token in self.bpe.merged(parts):
            if token in self.bpe.vocab:
                yield self.bpe.vocab[token]


class Decoder:
    """Ids to text, some at a time. Without a byte-level decoder in the file, tokens are joined by one space."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.begun = bpe, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace") if bpe.byte_level_decoder else None

    def feed(self, ids: Iterable[int]) -> str:
        tokens = [self.bpe.tokens[i] for i in ids if i in self.bpe.tokens]
        if not self.bpe.byte_level_decoder:
            out = " ".join(tokens)
            if tokens and self.begun:
                out = f" {out}"
            self.begun |= bool(tokens)
            return out
        out = b""
        for t in tokens:
            out += bytes(self.bpe.bytes_of[c] for c in t) if all(c in self.bpe.bytes_of for c in t) else t.encode()
        return self.utf8.decode(out)

    def end(self) -> str:
        return self.utf8.decode(b"", True) if self.utf8 else ""


class Cached(dict):
    """What ``make`` gives for a white-space run; emptied when full, so memory is bounded."""

    def __init__(self, make: Callable, most: int = 250_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, run):
        value = self.make(run)
        if len(run) <= RUN:
            if len(self) >= self.most:
                self.clear()
            self[run] = value
        return value


@functools.lru_cache(4)
def loaded(path: str) -> Bpe:
    return Bpe(path)


class Digests:
    """n_tokens, ids_sha256 and decoded_sha256 of a text, piece by piece."""

    def __init__(self, path: str):
        self.bpe = loaded(path)
        self.pairs = Cached(self._pair, 600_000)

    def _pair(self, run: str) -> tuple[str, str]:
        ids = [*self.bpe.plain(run)]
        return " ".join(map(str, ids)), Decoder(self.bpe).feed(ids)

    def of(self, text: str) -> tuple[int, str, str]:
        n, h, d, sep, fast = 0, hashlib.sha256(), hashlib.sha256(), "", self.bpe.whole and not self.bpe.byte_level_decoder
        decoder = Decoder(self.bpe)
        for piece in self.bpe.pieces(text):
            if fast and isinstance(piece, list):
                if not piece:
                    continue
                pairs = [*map(self.pairs.__getitem__, piece)]
                ids = " ".join([x for x, _ in pairs])
                out = " ".join([x for _, x in pairs])
                decoder.begun, out = True, (f" {out}" if decoder.begun else out)
            else:
                own = self.bpe.run(piece) if isinstance(piece, str) else [i for run in piece for i in self.bpe.run(run)]
                ids, out = " ".join(map(str, own)), decoder.feed(own)
            if ids:
                h.update(f"{sep}{ids}".encode())
                n, sep = n + ids.count(" ") + 1, " "
            d.update(out.encode())
        d.update(decoder.end().encode())
        return n, h.hexdigest(), d.hexdigest()


@functools.lru_cache(2)
def digester(path: str) -> Digests:
    """One a worker process, so that a task finds the runs that earlier ones met."""
    return Digests(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text. ``path``: a tokenizer file that every executor has."""

    def run(batches):
        digests = digester(path)
        for batch in batches:
            rows = [digests.of(t.as_py() or "") for t in batch.column(1)]
            n, ids, out = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
