"""Exact merge-type (BPE) piece encoding by backtracking, and decoding.

The encoder never runs the merge loop over a text.  For each space-delimited
part it walks left to right, takes the longest piece that an Aho-Corasick
automaton finds at the position, and keeps it only if it is *compatible* with
the piece before it: re-merging the two must not join them or cut them
differently.  Otherwise the next shorter match is tried, and when none fits the
last piece is taken back.  A bit field holds the positions from which encoding
is known to fail.  This gives the result of the merge loop exactly.

Characters outside the vocabulary become byte pieces, as the model's byte
fallback does.  Parts are independent as no piece holds a space mark behind
another character; the class checks that for the model it is given.

Defined results: a null text counts as empty, an empty text has no ids; repeated
rows are encoded each; an empty table gives an empty result; extra columns stay
out of the digest and pass through :func:`with_pieces`.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverylens.llm.common import documents, id_text, kept_alone, slices

SPACE = "▁"
#: Parts whose ids a worker remembers.
CACHE = 200_000


class PieceEncoder:
    """Backtracking encoder of one sentencepiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece as spm

        self.sp = spm.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        normal = [i for i in range(n) if not (self.sp.is_unknown(i) or self.sp.is_control(i) or self.sp.is_unused(i)
                                              or self.sp.is_byte(i))]
        self.id = {self.sp.id_to_piece(i): i for i in normal}
        self.score = {p: self.sp.get_score(i) for p, i in self.id.items()}
        self.byte = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece holds a space mark behind another character")
        # where no piece holds a letter beside another kind of character, parts are cut there too
        mixed = any(bool(_LETTER.match(a)) != bool(_LETTER.match(b)) for p in self.id
                    for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:]))
        self.part = _PART if mixed else _FINE_PART
        if self.sp.unk_id() in self.byte:
            raise ValueError("the model has no byte pieces")
        # pieces that are reachable, that is, that the merge loop makes from their own characters
        self.auto = ahocorasick.Automaton()
        self.whole = {p for p in self.id if len(p) == 1 or self._merged(p) == (p,)}
        for p in self.whole:
            self.auto.add_word(p, p)
        self.auto.make_automaton()
        self.pair: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, tuple] = {}

    def _merged(self, text: str) -> tuple[str, ...]:
        """The merge loop on a short string: best score first, then leftmost."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (s := self.score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-s, i, j, both))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if parts[i] is None or j >= n or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return tuple(p for p in parts if p is not None)

    def fits(self, left: str, right: str) -> bool:
        """Whether re-merging two adjacent pieces gives the same two again."""
        key = (left, right)
        ok = self.pair.get(key)
        if ok is None:
            if len(self.pair) > 1_000_000:
                self.pair.clear()
            ok = self.pair[key] = self._merged(left + right) == key
        return ok

    def pieces(self, part: str) -> list[str]:
        """Pieces of one part; characters that no piece holds stay as they are."""
        n = len(part)
        pair, fits = self.pair, self.fits
        # the leftmost longest matches are the answer where all neighbours are compatible
        quick = [p for _, p in self.auto.iter_long(part)]
        if sum(map(len, quick)) == n:
            for two in zip(quick, quick[1:]):
                ok = pair.get(two)
                if not (fits(*two) if ok is None else ok):
                    break
            else:
                return quick
        matches: list = [None] * n  # by start, longest last: the automaton reports them by end
        for end, piece in self.auto.iter(part):
            start = end + 1 - len(piece)
            if matches[start] is None:
                matches[start] = [piece]
            else:
                matches[start].append(piece)
        for i, found in enumerate(matches):
            if found is None:
                matches[i] = [part[i]]  # outside the vocabulary: a merge never touches it
        failed = 0
        out: list[str] = []
        choice: list[int] = []
        at, take, last = 0, len(matches[0]) - 1 if n else -1, ""
        while at < n:
            options = matches[at]
            while take >= 0:
                piece = options[take]
                stop = at + len(piece)
                if not failed >> stop & 1:
                    ok = pair.get((last, piece)) if last else True
                    if fits(last, piece) if ok is None else ok:
                        break
                take -= 1
            if take >= 0:
                out.append(piece)
                choice.append(take)
                at, last = stop, piece
                take = len(matches[at]) - 1 if at < n else -1
            else:
                if not out:
                    raise ValueError("no encoding")
                failed |= 1 << at
                at -= len(out.pop())
                last = out[-1] if out else ""
                take = choice.pop() - 1
        return out

    def part_ids(self, part: str) -> tuple[int, ...]:
        ids: list[int] = []
        for p in self.pieces(part):
            i = self.id.get(p)
            if i is not None:
                ids.append(i)
            else:
                ids.extend(self.byte[b] for b in p.encode("utf-8", "surrogatepass"))
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without begin or end."""
        return list(chain.from_iterable(map(_ids, self.parts(text))))

    def parts(self, text: str) -> list[tuple]:
        """(ids, their decimal text) of each part of a text, in order."""
        if not text:
            return []
        cache = self.cache
        names = self.part.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(cache.get, names))
        if None in found:
            if len(cache) > CACHE:
                cache.clear()
            for k, v in enumerate(found):
                if v is None:
                    p = names[k]
                    v = cache.get(p)
                    if v is None:
                        ids = self.part_ids(p)
                        v = (ids, ",".join(map(str, ids)))
                        if len(p) <= 64:
                            cache[p] = v
                    found[k] = v
        return found

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_LETTERS = "A-Za-z\u00c0-\u024f"
_LETTER = re.compile(f"[{_LETTERS}]")
_FINE_PART = re.compile(f"{SPACE}*(?:[{_LETTERS}]+|[^{_LETTERS}{SPACE}]+)|{SPACE}+")
_PART = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_ids, _decimal = itemgetter(0), itemgetter(1)
_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process; Spark reuses the processes between tasks."""
    if path not in kept_alone(_ENCODERS):
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def with_pieces(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, with_ids: ids array<int> and decoded too."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts):
                n_tokens, ids_hash, text_hash, all_ids, all_text = [], [], [], [], []
                for text in texts.slice(lo, hi - lo).to_pylist():
                    found = enc.parts(text)
                    ids = list(chain.from_iterable(map(_ids, found)))
                    decoded = enc.decode(ids)
                    n_tokens.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join(map(_decimal, found)).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids, np.int32))
                        all_text.append(decoded)
                cols = [ids_col.slice(lo, hi - lo), pa.array(n_tokens, pa.int64()), pa.array(ids_hash, pa.string()),
                        pa.array(text_hash, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    more = ", ids array<int>, decoded string" if with_ids else ""
    return id_text(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return with_pieces(documents(spark, sf_dir), model_path())
