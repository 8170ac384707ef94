"""BPE encoding and decoding as a bounded-lookahead streaming transducer over the merge list of a tokenizer file.

A token is emitted once no later symbol can change it.  How far the text must be known beyond a token follows from the merge list alone
(``MergeList.lookahead``); a word longer than a window is encoded window by window with that margin, so memory stays constant however
long a word or a text is.  Results equal those of the tokenizers library with ``add_special_tokens=False``; decoding equals its
``decode(ids, skip_special_tokens=False)``, and ``ByteDecoder`` turns ids into readable text byte by byte.

Defined results: null counts as empty text, empty text has no tokens and decodes to the empty text; repeated rows give repeated results;
an empty table gives an empty one; columns other than the named two are not looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import slices

TOKENIZER = "word_bpe_49k.json"
#: Entries of a task's table of words already encoded; it is begun anew when full.
REMEMBERED = 150_000
#: Characters encoded at a time.
WINDOW = 1 << 16
#: Bits of an id in a pair's key.
ID_BITS = 20
#: White_Space of Unicode; Python's own split also takes \x1c-\x1f.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
GAPS = regex.compile(f"[{SPACE}]+")
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
#: Most pieces: letters of Latin-1, which normal form leaves alone, then signs that stand for nothing else.
SIMPLE = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([!-&(-/:;=-@\[-`{-~]*)")
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeList:
    """Vocabulary, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.symbols = byte_symbols()
        self.merges: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((left, right), rank)
        self.lookahead, self.longest = self._lookahead()
        # The same by id: a byte's symbol, that with the word's end, a pair's rank and what it makes.
        self.base = [self.vocab.get(c, -1) for c in self.symbols]
        self.ended = {self.vocab[c]: self.vocab[c + self.suffix] for c in self.symbols if c in self.vocab and c + self.suffix in self.vocab}
        known = [(self.vocab.get(a, -1), self.vocab.get(b, -1), self.vocab.get(a + b, -1)) for a, b in self.merges]
        self.ranks = {a << ID_BITS | b: rank for rank, (a, b, made) in enumerate(known) if min(a, b, made) >= 0}
        self.made = [made for _, _, made in known]
        self.sizes = {i: self.size(t) for t, i in self.vocab.items()}

    def size(self, token: str) -> int:
        """Symbols of a token; the word's end adds none."""
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) else 0)

    def _lookahead(self) -> tuple[int, int]:
        """Symbols beyond a token that suffice to know it, and the longest token.

        A merge of rank r of ``a`` and ``b`` fails only if a part on the right edge of ``b`` went to the right before: in a merge (x, y) of a
        lower rank than the one that would have bound x to its left.  To know that takes y and whatever (x, y) itself depends on, so the
        need of a merge is the largest ``size(y) + need(x, y)`` over such merges.  Ranks fall along each chain, so every need is known
        when it is asked for.
        """
        ranks: dict[str, list[int]] = {}  # by left part: ranks so far, and the largest need among them
        most: dict[str, list[int]] = {}
        made: dict[str, tuple[str, int]] = {}  # by token: its right part, and the rank that made it
        need = longest = 0
        for (left, right), rank in self.merges.items():
            own, part, bound = 0, right, rank
            while part:
                if part in ranks and (at := bisect_left(ranks[part], bound)):
                    own = max(own, most[part][at - 1])
                part, bound = made.get(part, ("", 0))
            ranks.setdefault(left, []).append(rank)
            before = most.setdefault(left, [])
            before.append(max(before[-1] if before else 0, self.size(right) + own))
            made.setdefault(left + right, (right, rank))
            need, longest = max(need, self.size(right) + own), max(longest, self.size(left + right))
        return need, longest

    def merge(self, ids: list[int]) -> list[int]:
        """The token ids of a sequence of symbol ids, in place: the pair of lowest rank first, leftmost first."""
        rank, made, big = self.ranks.get, self.made, len(self.made)
        ranks = [rank(a << ID_BITS | b, big) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == big:
                break
            i = ranks.index(best)
            del ids[i], ranks[i]
            ids[i] = here = made[best]
            if i < len(ranks):
                ranks[i] = rank(here << ID_BITS | ids[i + 1], big)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << ID_BITS | here, big)
        return ids


class Transducer:
    """Takes the symbol ids of one word bit by bit and gives its token ids as they become stable."""

    def __init__(self, merges: MergeList, window: int = 0):
        self.list = merges
        self.window = max(window, 2 * (merges.lookahead + merges.longest))
        self.held: list[int] = []

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        symbols = iter(symbols)
        while more := list(islice(symbols, self.window)):
            self.held += more
            if len(self.held) > self.window:
                yield from self._settled()

    def _settled(self) -> Iterator[int]:
        """Tokens that end at least a lookahead before the end of what is held; they leave."""
        end, sizes = 0, self.list.sizes
        for token in self.list.merge(self.held[:]):
            if end + sizes[token] > len(self.held) - self.list.lookahead:
                break
            end += sizes[token]
            yield token
        del self.held[:end]

    def finish(self) -> list[int]:
        """The rest, with the word's end marked."""
        held, self.held = self.held, []
        return self.whole(held) if held else []

    def whole(self, symbols: list[int]) -> list[int]:
        """A word, or its rest, that fits into the window."""
        if self.list.suffix:
            symbols[-1] = self.list.ended[symbols[-1]]
        return self.list.merge(symbols)


class Encoder:
    """Texts to ids.  Words are encoded by the transducer once and remembered, up to a bound."""

    def __init__(self, merges: MergeList, remembered: int = REMEMBERED):
        self.list, self.remembered, self.machine = merges, remembered, Transducer(merges)
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) or r"(?!)")

    def word(self, word: str) -> tuple[int, ...]:
        got = self.words.get(word)
        if got is None:
            symbols, machine = list(map(self.list.base.__getitem__, word.encode())), self.machine
            got = tuple(machine.whole(symbols) if len(symbols) <= machine.window else (*machine.feed(symbols), *machine.finish()))
            if len(word) <= 64:
                if len(self.words) >= self.remembered:
                    self.words.clear()
                self.words[word] = got
        return got

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """``piece``, remembered."""
        got = self.piece(chunk)
        if len(chunk) <= 64:
            if len(self.chunks) >= self.remembered:
                self.chunks.clear()
            self.chunks[chunk] = got
        return got

    def piece(self, chunk: str) -> tuple[int, ...]:
        """Ids of a piece of text without white space."""
        if simple := SIMPLE.fullmatch(chunk):
            letters, signs = simple.groups()
            got = (self.word(letters.lower()) if letters else ()) + (self.word(signs) if signs else ())
        else:
            ids: list[int] = []
            at = 0
            for found in self.specials.finditer(chunk):
                self._plain(chunk[at : found.start()], ids)
                ids.append(self.list.special[found.group()])
                at = found.end()
            self._plain(chunk[at:], ids)
            got = tuple(ids)
        return got

    def _plain(self, piece: str, ids: list[int]) -> None:
        if not piece.isascii():
            # Each character is lowered by itself: a sigma at a word's end stays an ordinary one.
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        for word in WORD.findall(piece.lower()):
            ids.extend(self.word(word))

    def stream(self, text: str, size: int = WINDOW) -> Iterator[list[int]]:
        """Ids of the text as they settle, a window of some ``size`` characters at a time: none reaches over white space, and longer words go through the transducer."""
        at = 0
        while at < len(text):
            gap = GAPS.search(text, at + size)
            end = gap.end() if gap else len(text)
            if ids := self.encode(text[at:end]):
                yield ids
            at = end

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, encode, add = self.chunks.get, self.chunk, ids.extend
        for chunk in GAPS.split(text) if ODD_SPACE.search(text) else text.split():
            add(known(chunk) or encode(chunk))
        return ids


class TokenDecoder:
    """The library's decoding for files without a decoder: token texts with a blank between; ids come one by one or many at once."""

    def __init__(self, merges: MergeList):
        self.texts = [merges.tokens.get(i, "").encode() for i in range(max(merges.tokens) + 1)]
        self.begun = False

    def feed(self, ids: list[int]) -> bytes:
        if not ids:
            return b""
        out = b" ".join(map(self.texts.__getitem__, ids))
        out, self.begun = b" " + out if self.begun else out, True
        return out


class ByteDecoder:
    """Ids to readable text: bytes go through an incremental UTF-8 state machine, so a character split over tokens comes out once whole."""

    def __init__(self, merges: MergeList):
        self.list = merges
        self.bytes = {s: b for b, s in enumerate(merges.symbols)}
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, i: int) -> str:
        token = self.list.tokens[i]
        if token in self.list.special:
            return self.machine.decode(b"", final=True) + token
        ended = bool(self.list.suffix) and token.endswith(self.list.suffix)
        body = token[: -len(self.list.suffix)] if ended else token
        return self.machine.decode(bytes(self.bytes[s] for s in body)) + (" " if ended else "")

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


@lru_cache(maxsize=2)
def merge_list(path: str) -> MergeList:
    return MergeList(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(merge_list(path))


def _texts(part: pa.RecordBatch) -> list[str]:
    return [x or "" for x in part.column("text").to_pylist()]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every whole text."""
    file = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids = [encoder(file).encode(x) for x in _texts(part)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of rows of ``encode``, as the library decodes them."""
    file = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = [TokenDecoder(merge_list(file)).feed(ids or []).decode() for ids in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: ids leave the encoder window by window into the running digests and the decoder, none is kept."""
    file = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = [b"%d" % i for i in range(max(merge_list(file).tokens) + 1)]
        plain = TokenDecoder(merge_list(file))
        for part in slices(batches, "text"):
            sizes, ids_sha, decoded_sha = [], [], []
            for text in _texts(part):
                n, own, back, plain.begun = 0, hashlib.sha256(), hashlib.sha256(), False
                for ids in encoder(file).stream(text):
                    own.update((b" " if n else b"") + b" ".join(map(decimal.__getitem__, ids)))
                    back.update(plain.feed(ids))
                    n += len(ids)
                sizes.append(n)
                ids_sha.append(own.hexdigest())
                decoded_sha.append(back.hexdigest())
            columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    return docs.select(*columns).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
