"""Token counts by a compiled finite-state transducer over characters.

Method: finite-state tokenizer compilation. For a byte-pair vocabulary, the last
token of the encoding of every prefix is unique, and the encoding of a prefix is
that of a shorter prefix plus this token. Which token it is depends on a bounded
window only: the characters that may still be the start of a longer token, and
the last tokens at those places. This window is the state. A transition reads one
character and is annotated with the change in the number of emitted tokens.
States and transitions are compiled when first met and kept in a hash table of arrays, so
that many places of many texts make a step together, by gathering from the table.

All texts of an Arrow batch are cut into chunks, and each chunk is reduced to its state
map: for the states that can enter it, the state it leaves in and the tokens counted.
Chunks begin where the transducer restarts, which is before every word and between two
neighbouring characters that no token holds side by side: there the map is the same
for every entry state, and is computed for one. A stretch without a restart that is longer
than CHUNK is cut anyhow; its chunks get maps over all states that the stretch's characters can
reach, and these compose by a parallel prefix scan in log-many rounds, each of them
one gather of arrays. (Where more than ENTRIES states can be reached, the stretch is read
from its one true entry state instead, which is the map over that state.)

Counts equal the library's: a dummy space before a non-empty text, every space is
U+2581, characters outside the vocabulary cost one token per UTF-8 byte and merge
with nothing, and strings that look like control tokens are ordinary text.

Defined results: a null or empty text has 0 tokens; repeated rows count each; an
empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Slots of the table of transitions and states; a table half full starts anew after its batch, a fuller one grows. That bounds memory, never changes a count.
SLOTS, TABLE_LIMIT = 1 << 20, 400_000
#: Characters of a chunk, and states that can enter one inside a stretch without restarts.
CHUNK, ENTRIES = 64, 256
#: Characters below this have their pairs in a plane of bits.
PLANE = 2048
#: Characters that are read together.
TOGETHER = 1 << 20


class Transducer:
    """pieces: token string -> merge rank (smaller merges first)."""

    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        self.starts = {p[:k] for p in pieces for k in range(1, len(p))}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a token crosses from a word into a space; words can't be restarts")
        self.fits: dict[tuple[str, str], bool] = {}
        beside = np.array([(ord(p[k]), ord(p[k + 1])) for p in pieces for k in range(len(p) - 1)], np.int64).reshape(-1, 2)
        self.beside = np.unique((beside[:, 0] << 21) | beside[:, 1])
        self.near = np.zeros((PLANE, PLANE), bool)  # the same for common characters
        common = beside[(beside < PLANE).all(axis=1)]
        self.near[common[:, 0], common[:, 1]] = True
        self.reset()

    def reset(self) -> None:
        # A state lists every place where a longer token may have begun, the earliest
        # first and the place reached last: (characters since, last token there, tokens there less tokens here).
        self.states: list[tuple[tuple[str, str, int], ...]] = [(("", "", 0),)]
        self.numbers = {self.states[0]: 0}
        self._empty(SLOTS)

    def _empty(self, slots: int) -> None:
        self.keys = np.full(slots, -1, np.int64)  # state and character
        self.exits, self.counts = np.zeros(slots, np.int32), np.zeros(slots, np.int16)
        self.used = 0

    def _insert(self, keys: np.ndarray, exits: np.ndarray, counts: np.ndarray) -> None:
        """Put new keys into the table, which grows while they would fill it beyond three quarters."""
        if 4 * (self.used + len(keys)) > 3 * len(self.keys):
            full = self.keys != -1
            keys, exits, counts = np.append(self.keys[full], keys), np.append(self.exits[full], exits), np.append(self.counts[full], counts)
            slots = len(self.keys)
            while 4 * len(keys) > 3 * slots:
                slots *= 2
            self._empty(slots)
        self.used += len(keys)
        while len(keys):  # of those that want one slot, the first gets it
            at = self._slots(keys)
            slot, first = np.unique(at, return_index=True)
            self.keys[slot], self.exits[slot], self.counts[slot] = keys[first], exits[first], counts[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, exits, counts = keys[left], exits[left], counts[left]

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging as defined: the best-ranked adjacent pair first, leftmost on ties."""
        rank, none = self.pieces.get, 1 << 60
        parts = list(text)
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], none)
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], none)
        return parts

    def follows(self, last: str, token: str) -> bool:
        """Whether the encoding of last + token keeps the two as they are."""
        key = (last, token)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 4 * TABLE_LIMIT:
                self.fits.clear()
            known = self.fits[key] = self.merge(last + token) == ([last, token] if last else [token])
        return known

    def compiled(self, state: int, char: str) -> tuple[int, int]:
        """The transition of a state at a character: (next state, change in the number of tokens)."""
        places = self.states[state]
        for since, last, count in places:  # the longest token first; exactly one fits
            token = since + char
            if (token in self.pieces or not since) and self.follows(last, token):
                break
        change = count + (1 if token in self.pieces else len(char.encode("utf-8", "surrogatepass")))
        open_places = tuple((since + char, last, count - change) for since, last, count in places if since + char in self.starts)
        new = (*open_places, ("", token, 0)) if open_places else self.states[0]
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
        return number, change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key lies in the table, or the free slot where it will."""
        last = len(self.keys) - 1
        at = ((keys * np.int64(-7046029254386353131)) >> np.int64(32)) & last
        found = self.keys[at]
        apart = np.flatnonzero((found != keys) & (found != -1))
        while len(apart):
            at[apart] = (at[apart] + 1) & last
            found = self.keys[at[apart]]
            apart = apart[(found != keys[apart]) & (found != -1)]
        return at

    def step(self, states: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transitions of many states, each at its own character."""
        keys = (states.astype(np.int64) << 21) | chars
        at = self._slots(keys)
        missing = np.flatnonzero(self.keys[at] == -1)
        if len(missing):
            new = np.unique(keys[missing])
            made = [self.compiled(key >> 21, chr(key & 0x1FFFFF)) for key in new.tolist()]
            self._insert(new, np.array([x for x, _ in made], np.int32), np.array([x for _, x in made], np.int16))
            at = self._slots(keys)
        return self.exits[at], self.counts[at].astype(np.int64)

    def read(self, chars: np.ndarray, begins: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read every stretch [begin, end) of `chars` from its own state, all of them in step: exit states and counts."""
        order = np.argsort(begins - ends, kind="stable")  # the longest first, so that those still running lead
        length = (ends - begins)[order]
        at, state, total = begins[order].copy(), states[order].astype(np.int32), np.zeros(len(order), np.int64)
        running = len(order)
        for k in range(int(length.max(initial=0))):
            while running and length[running - 1] <= k:
                running = int(np.searchsorted(-length, -k, side="left"))
            state[:running], change = self.step(state[:running], chars[at[:running] + k])
            total[:running] += change
        exits, counts = np.empty_like(state), np.empty_like(total)
        exits[order], counts[order] = state, total
        return exits, counts

    def held_together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether some token holds the two characters side by side."""
        known = self.near[np.minimum(left, PLANE - 1), np.minimum(right, PLANE - 1)]
        rare = np.flatnonzero((left >= PLANE - 1) | (right >= PLANE - 1))
        if len(rare):
            pairs = (left[rare] << 21) | right[rare]
            known[rare] = self.beside[np.minimum(np.searchsorted(self.beside, pairs), len(self.beside) - 1)] == pairs
        return known

    def fresh(self) -> None:
        """Start the table anew if it is half full: between batches only."""
        if 2 * self.used > SLOTS or len(self.states) > TABLE_LIMIT:
            self.reset()
        if len(self.fits) > TABLE_LIMIT:
            self.fits.clear()

    def reachable(self, chars: np.ndarray) -> np.ndarray | None:
        """All states that these characters lead to from a restart, in any order and number; None if more than ENTRIES."""
        known, fresh = np.zeros(1, np.int32), np.zeros(1, np.int32)
        while len(fresh):
            if len(known) * len(chars) > ENTRIES * 8:
                return None
            exits, _ = self.step(np.repeat(fresh, len(chars)), np.tile(chars, len(fresh)))
            fresh = np.setdiff1d(exits, known)
            known = np.union1d(known, fresh)
        return known if len(known) <= ENTRIES else None


def compose(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Maps of neighbouring chunks, a row each: exits (as places among the entry states) and counts by entry state. Associative."""
    return np.take_along_axis(b[0], a[0], 1), a[1] + np.take_along_axis(b[1], a[0], 1)


def prefix_scan(exits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The map of all chunks (rows) one after the other, by pairs of neighbours in log-many rounds."""
    while len(exits) > 1:
        odd = (exits[-1:], counts[-1:]) if len(exits) % 2 else None
        n = len(exits) // 2 * 2
        exits, counts = compose((exits[0:n:2], counts[0:n:2]), (exits[1:n:2], counts[1:n:2]))
        if odd:
            exits, counts = np.vstack([exits, odd[0]]), np.vstack([counts, odd[1]])
    return exits[0], counts[0]


def count_stretch(machine: Transducer, chars: np.ndarray, chunk: int = CHUNK) -> int:
    """Tokens of a long stretch that begins at a restart and has none inside."""
    entries = machine.reachable(np.unique(chars))
    if entries is None:
        return int(machine.read(chars, np.array([0]), np.array([len(chars)]), np.array([0]))[1][0])
    begins = np.arange(0, len(chars), chunk)
    ends = np.minimum(begins + chunk, len(chars))
    n, total, entry = len(entries), 0, 0
    together = max(1, TOGETHER // (n * chunk))
    for i in range(0, len(begins), together):  # maps of so many chunks are held at once
        b, e = begins[i : i + together], ends[i : i + together]
        exits, counts = machine.read(chars, np.repeat(b, n), np.repeat(e, n), np.tile(entries, len(b)))
        exits, counts = prefix_scan(np.searchsorted(entries, exits).reshape(-1, n), counts.reshape(-1, n))
        total, entry = total + int(counts[entry]), int(exits[entry])
    return total


def count_batch(machine: Transducer, texts: list[str | None], chunk: int = CHUNK) -> list[int]:
    """Tokens of whole texts, null or empty: 0."""
    machine.fresh()
    texts = [(" " + x).replace(" ", SPACE) if x else "" for x in texts]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(chars):
        return [0] * len(texts)
    sizes = np.array([len(x) for x in texts])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    space = ord(SPACE)
    restart = np.zeros(len(chars), bool)
    restart[edges[:-1][sizes > 0]] = True
    restart[1:] |= ~machine.held_together(chars[:-1], chars[1:]) | ((chars[1:] == space) & (chars[:-1] != space))
    begins = np.flatnonzero(restart)
    ends = np.append(begins[1:], len(chars))
    counts = np.zeros(len(begins), np.int64)
    short = np.flatnonzero(ends - begins <= chunk)
    counts[short] = machine.read(chars, begins[short], ends[short], np.zeros(len(short), np.int32))[1]
    for k in np.flatnonzero(ends - begins > chunk):
        counts[k] = count_stretch(machine, chars[begins[k] : ends[k]], chunk)
    running = np.concatenate([[0], np.cumsum(counts)])
    at = np.searchsorted(begins, edges)
    return (running[at[1:]] - running[at[:-1]]).tolist()


def count_tokens(machine: Transducer, text: str | None, chunk: int = CHUNK) -> int:
    return count_batch(machine, [text], chunk)[0]


@lru_cache(maxsize=2)
def compile_model(path: str) -> Transducer:
    """The transducer of a byte-pair model file; one per worker process."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    order = sorted(ids, key=lambda i: -model.get_score(i))
    return Transducer({model.id_to_piece(i): rank for rank, i in enumerate(order)})


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row, whole texts, no shuffle."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = compile_model(model_path)
        for batch in texts:
            sizes = batch.str.len().cumsum() // TOGETHER  # at most so many characters together, but for one long text
            yield pd.concat([pd.Series(count_batch(machine, list(part)), dtype="int64") for _, part in batch.groupby(sizes)] or [pd.Series([], dtype="int64")], ignore_index=True)

    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), count(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
