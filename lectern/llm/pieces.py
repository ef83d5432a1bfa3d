"""SentencePiece BPE encoding and decoding by a prefix table.

Every prefix of a word has exactly one encoding, so it has exactly one last token.  A word's table
is filled from left to right: of the pieces that an automaton finds to end at a place, one
alone is compatible with the last token of the prefix before it.  The ids are then read backwards
from the end.  The table is filled for all distinct words of a batch in step, by array operations.

Two pieces are compatible when the merges never join across their border.  Going back in time, the
younger of the two symbols at the border is undone until both are characters; whenever the
two could be joined by a better-ranked merge than the one that ends either of them, the pair
would not have survived.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for a space inside pieces (fixed by the format).
SPACE = "▁"
#: Score shared by the pieces that only hold spaces: joined after all others, leftmost first.
NEVER = np.int64(1) << 40
#: Characters with a full row in the automaton; others are looked up by search.
DENSE = 192
#: Words longer than this are cut where no piece crosses.
LONG = 64
#: Distinct words that a task remembers, and characters it cuts up at a time.
REMEMBERED, AT_ONCE = 400_000, 1_000_000
#: Slots of the table of tested pairs.
SLOTS = 1 << 20


def merge(symbols: list[str], rank) -> tuple[list[str], tuple[str, str] | None]:
    """Symbols after all merges (best rank first, then leftmost), and the pair merged last."""
    after = list(range(1, len(symbols))) + [-1]
    before = list(range(-1, len(symbols) - 1))
    symbols, agenda, last = list(symbols), [], None

    def offer(i):
        j = after[i] if i >= 0 else -1
        if j >= 0 and (r := rank(symbols[i] + symbols[j])) is not None:
            heapq.heappush(agenda, (r, i, symbols[i], symbols[j]))

    for i in range(len(symbols) - 1):
        offer(i)
    while agenda:
        _, i, a, b = heapq.heappop(agenda)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue
        last, symbols[i], symbols[j] = (a, b), a + b, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [s for s in symbols if s], last


class Vocabulary:
    """Tables of a BPE model with byte fallback; built once on the driver, bounded by the model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if model.encode("a  b", out_type=str) == model.encode("a b", out_type=str):
            raise ValueError("models that change white space are not supported")
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (
            model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_ids = np.array(
            [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_ids)}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        ids = {self.pieces[i]: i for i in plain}
        if any("\n" in p for p in ids):
            raise ValueError("models with line feeds inside pieces are not supported")
        scores = sorted({-model.get_score(i) for i in plain})
        place = {s: k for k, s in enumerate(scores)}
        ranks = {self.pieces[i]: place[-model.get_score(i)] for i in plain}
        self.runs = {p: r for p, r in ranks.items() if len(p) > 1 and set(p) == {SPACE}}
        if any(SPACE in p[1:] for p in ids if p not in self.runs):
            raise ValueError("models with spaces inside pieces are not supported")
        worst = max((r for p, r in ranks.items() if len(p) > 1 and p not in self.runs), default=0)
        if self.runs and min(self.runs.values()) <= worst:
            raise ValueError("models that join spaces before words are not supported")
        self.ids = ids
        words = {p: r for p, r in ranks.items() if p not in self.runs}

        self.size = n
        self.born = np.full(n + 1, -1, np.int64)  # a character is there from the start
        self.left, self.right = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
        self.length = np.ones(n + 1, np.int32)
        usable = []
        for p, r in words.items():
            i = ids[p]
            self.length[i] = len(p)
            if len(p) == 1:
                usable.append(p)
                continue
            found, last = merge(list(p), words.get)
            if found == [p] and all(x in ids for x in last):
                self.left[i], self.right[i] = ids[last[0]], ids[last[1]]
                self.born[i] = r
                usable.append(p)
        for p in usable:  # undoing merges in order of rank needs parts that are older than the whole
            i = ids[p]
            if len(p) > 1 and max(self.born[self.left[i]], self.born[self.right[i]]) >= self.born[i]:
                raise ValueError(f"piece ranked before its parts: {p}")
        joins = {}
        for p, r in words.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    joins[a * (n + 1) + b] = r
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_ranks = np.array([joins[k] for k in self.join_keys.tolist()], np.int64)

        counts: dict[str, int] = {}
        for p in usable:
            for c in p:
                counts[c] = counts.get(c, 0) + 1
        chars = sorted(counts, key=lambda c: (-counts[c], c))
        self.classes = np.zeros(0x110000, np.int32)
        for k, c in enumerate(chars, 1):
            self.classes[ord(c)] = k
        nodes, tokens, steps = {"": 0}, [-1], {}
        for p in sorted(usable):
            at = 0
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(tokens)
                    tokens.append(-1)
                    steps[at * (len(chars) + 1) + int(self.classes[ord(p[k - 1])])] = nodes[p[:k]]
                at = nodes[p[:k]]
            tokens[at] = ids[p]
        self.tokens = np.array(tokens, np.int32)
        self.width = len(chars) + 1
        self.step_keys = np.array(sorted(steps), np.int64)
        self.step_to = np.array([steps[k] for k in self.step_keys.tolist()], np.int32)
        met = {(p[k], p[k + 1]) for p in usable for k in range(len(p) - 1)}
        self.met = np.zeros((DENSE, DENSE), bool)
        for a, b in met:
            x, y = self.classes[ord(a)], self.classes[ord(b)]
            if x < DENSE and y < DENSE:
                self.met[x, y] = True


class Encoder:
    """Encodes words with a ``Vocabulary``; holds what a task has learned so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.dense = np.zeros((len(v.tokens), DENSE), np.int32)
        at, cls = np.divmod(v.step_keys, v.width)
        low = cls < DENSE
        self.dense[at[low], cls[low]] = v.step_to[low]
        self.pair_keys = np.full(SLOTS, -1, np.int64)
        self.pair_fits = np.zeros(SLOTS, bool)
        self.run_ids: dict[int, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.text: list[str] = []
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _step(self, node: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = np.zeros(len(node), np.int32)
        low = cls < DENSE
        if low.all():
            return self.dense[node, cls]
        out[low] = self.dense[node[low], cls[low]]
        high = np.flatnonzero(~low)
        keys = node[high].astype(np.int64) * self.v.width + cls[high]
        i = np.minimum(np.searchsorted(self.v.step_keys, keys), len(self.v.step_keys) - 1)
        out[high] = np.where(self.v.step_keys[i] == keys, self.v.step_to[i], 0)
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens ``a`` and ``b`` may stand side by side; tested pairs are remembered."""
        keys = a.astype(np.int64) * (self.v.size + 1) + b
        slot = (keys * -7046029254386353131 >> 40) & (SLOTS - 1)
        new = self.pair_keys[slot] != keys
        if new.any():
            fresh = np.unique(keys[new])
            fits = self._test(*np.divmod(fresh, self.v.size + 1))
            out = np.empty(len(keys), bool)
            out[~new] = self.pair_fits[slot[~new]]
            out[new] = fits[np.searchsorted(fresh, keys[new])]
            at = (fresh * -7046029254386353131 >> 40) & (SLOTS - 1)
            self.pair_keys[at], self.pair_fits[at] = fresh, fits
            clash = self.pair_keys[at] != fresh  # the last of a slot stays, with its own answer
            if clash.any():
                won = np.searchsorted(fresh, self.pair_keys[at[clash]])
                self.pair_fits[at[clash]] = fits[won]
            return out
        return self.pair_fits[slot]

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        v, n = self.v, self.v.size
        fits = np.ones(len(a), bool)
        x, y = a.astype(np.int64), b.astype(np.int64)
        ends_x, ends_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        live = np.flatnonzero((x < n) & (y < n))  # id n stands for a character without a piece
        while len(live):
            keys = x[live] * (n + 1) + y[live]
            i = np.minimum(np.searchsorted(v.join_keys, keys), len(v.join_keys) - 1)
            rank = np.where(v.join_keys[i] == keys, v.join_ranks[i], NEVER)
            # of equal ranks the leftmost merge comes first
            broken = (rank < ends_x[live]) & (rank <= ends_y[live]) & (rank < NEVER)
            fits[live[broken]] = False
            live = live[~broken]
            bx, by = v.born[x[live]], v.born[y[live]]
            live = live[(bx >= 0) | (by >= 0)]
            bx, by = v.born[x[live]], v.born[y[live]]
            one = live[bx > by]
            ends_x[one], x[one] = v.born[x[one]], v.right[x[one]]
            two = live[bx <= by]
            ends_y[two], y[two] = v.born[y[two]], v.left[y[two]]
        return fits

    def _tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token at every token end of the words, in order, and the number of each word's."""
        v = self.v
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        offsets = np.cumsum(sizes) - sizes
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        cls = v.classes[chars]
        last = np.full(len(chars), -1, np.int32)
        last[cls == 0] = v.size
        order = np.argsort(-sizes, kind="stable")
        by_size, off = sizes[order], offsets[order]
        n_active = np.searchsorted(-by_size, -np.arange(int(sizes.max(initial=0))), side="left")
        for s, n in enumerate(n_active.tolist()):
            at = off[:n] + s
            room = by_size[:n] - s
            before = last[at - 1] if s else None
            who = np.flatnonzero(cls[at] > 0)
            node = self._step(np.zeros(len(who), np.int32), cls[at[who]])
            k = 1
            while len(who):
                token = v.tokens[node]
                ends = np.flatnonzero(token >= 0)
                if len(ends):
                    if s:
                        ends = ends[self._fits(before[who[ends]], token[ends])]
                    last[at[who[ends]] + k - 1] = token[ends]
                more = room[who] > k
                who, node = who[more], node[more]
                node = self._step(node, cls[at[who] + k])
                on = node > 0
                who, node = who[on], node[on]
                k += 1
        ends = np.zeros(len(chars), bool)
        at = offsets + sizes - 1
        low = offsets
        while len(at):
            ends[at] = True
            at = at - v.length[last[at]]
            more = at >= low
            at, low = at[more], low[more]
        per_word = np.add.reduceat(ends, offsets) if len(words) else np.zeros(0, np.int64)
        spots = np.flatnonzero(ends)
        return np.stack([last[spots], chars[spots].astype(np.int64)]), per_word

    def _cut(self, word: str) -> list[str]:
        """A long word in parts, cut between characters that no piece holds side by side."""
        cls = self.v.classes[np.frombuffer(word.encode("utf-32-le"), np.uint32)]
        a, b = cls[:-1], cls[1:]
        free = (a == 0) | (b == 0)
        low = (a < DENSE) & (b < DENSE) & ~free
        free[low] = ~self.v.met[a[low], b[low]]
        at = [0, *(np.flatnonzero(free) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(at, at[1:])]

    def _run(self, n: int) -> list[int]:
        """Ids of ``n`` spaces that join no word."""
        if n not in self.run_ids:
            found, _ = merge([SPACE] * n, self.v.runs.get)
            self.run_ids[n] = [self.v.ids[p] for p in found]
        return self.run_ids[n]

    def learn(self, chunks) -> None:
        """Encode the chunks (spaces, then characters other than spaces) that are not known yet."""
        new = [c for c in chunks if c not in self.place]
        if not new:
            return
        words, owner, lead = [], [], []
        for i, c in enumerate(new):
            body = c.lstrip(SPACE)
            spaces = len(c) - len(body)
            lead.append(max(0, spaces - 1) if body else spaces)
            word = (SPACE if spaces and body else "") + body
            parts = self._cut(word) if len(word) > LONG else [word] if word else []
            words += parts
            owner += [i] * len(parts)
        (tokens, chars), per_word = self._tokens(words)
        per_chunk = np.bincount(np.array(owner, np.int64), per_word, len(new)).astype(np.int64)
        odd = np.zeros(len(new), bool)
        odd[np.array(owner, np.int64)[np.repeat(np.arange(len(words)), per_word)[tokens == self.v.size]]] = True
        odd |= np.array(lead) > 0
        starts = np.cumsum(per_chunk) - per_chunk
        pool = tokens.astype(np.int32)
        added: list[np.ndarray] = []
        extra, counts, begins = len(pool), per_chunk.copy(), starts.copy()
        for i in np.flatnonzero(odd).tolist():  # spaces in a row, and characters without a piece
            s, e = starts[i], starts[i] + per_chunk[i]
            ids, codes = tokens[s:e].tolist(), chars[s:e].tolist()
            if lead[i]:
                alone = bool(ids) and ids[0] == self.v.ids.get(SPACE, -1)
                head = self._run(lead[i] + alone)
                ids, codes = head + ids[alone:], [0] * len(head) + codes[alone:]
            flat: list[int] = []
            for t, c in zip(ids, codes):
                flat += [t] if t < self.v.size else self.v.byte_ids[list(chr(c).encode())].tolist()
            added.append(np.array(flat, np.int32))
            begins[i], counts[i] = extra, len(flat)
            extra += len(flat)
        base = len(self.pool)
        self.pool = np.concatenate([self.pool, pool, *added])
        self.start = np.concatenate([self.start, begins + base])
        self.count = np.concatenate([self.count, counts])
        ids = self.pool[base:].tolist()
        for c, s, n in zip(new, begins.tolist(), counts.tolist()):
            self.place[c] = len(self.text)
            self.text.append(decode_part(self.v, ids[s:s + n]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row, their offsets, and the decoded texts."""
        cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+").findall
        chunks = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = {c for cs in chunks for c in cs}
        if len(self.place) + len(fresh) > REMEMBERED:
            self.forget()
        self.learn(fresh)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        place, text = self.place.__getitem__, self.text.__getitem__
        at = np.fromiter((p for cs in chunks for p in map(place, cs)), np.int64, int(sizes.sum()))
        n = self.count[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        spots = np.repeat(self.start[at] - upto[:-1], n) + np.arange(upto[-1])
        offsets = upto[np.concatenate([[0], np.cumsum(sizes)])]
        decoded, i, listed = [], 0, at.tolist()
        for size in sizes.tolist():
            decoded.append("".join(map(text, listed[i:i + size])).removeprefix(" "))
            i += size
        return self.pool[spots], offsets, decoded


def decode_part(v: Vocabulary, ids: list[int]) -> str:
    """Text of ids, with the space that starts a text still in place."""
    out, held = [], bytearray()
    for i in ids:
        if i in v.byte_of:
            held.append(v.byte_of[i])
            continue
        if held:
            out.append(_bytes_text(held))
            held = bytearray()
        if i == v.unknown:
            out.append(" ⁇ ")
        elif i not in v.silent:
            out.append(v.pieces[i])
    if held:
        out.append(_bytes_text(held))
    return "".join(out).replace(SPACE, " ")


def _bytes_text(held: bytearray) -> str:
    """UTF-8 text; every byte that belongs to no character becomes U+FFFD."""
    try:
        return held.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(held):
            for n in (1, 2, 3, 4):
                try:
                    out.append(held[i:i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def decode(v: Vocabulary, ids: list[int]) -> str:
    """Text of a whole id sequence; bytes of one character may lie anywhere side by side."""
    return decode_part(v, ids).removeprefix(" ")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of about ``AT_ONCE`` bytes of text (a longer text by itself)."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > AT_ONCE:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def encode_pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, ids (array of int), decoded (the text those ids stand for).

    ``path`` is a BPE model with byte fallback and identity normalisation; only the driver reads
    it.  A null or empty text has no ids and decodes to the empty text.  Null ids and repeated
    rows are kept; other columns are not read.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(path))  # bounded by the model
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in (part for whole in batches for part in slices(whole)):
            ids, offsets, decoded = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                pa.array(decoded, pa.string()),
            ], ["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def piece_digests(encoded: DataFrame) -> DataFrame:
    """Number and digest of the ids and digest of the decoded text, per row of ``encode_pieces``."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
