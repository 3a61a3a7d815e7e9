"""Token counts of whole texts under a piece vocabulary with byte fallback.

Pre-tokens of a batch are held as ragged numpy arrays, one run of symbols each.  In every round each
sequence applies its pair of lowest rank, all of them at once over the batch, until no sequence has a
pair left; the surviving symbols are counted.  A pre-token is a run of spaces with the word behind it:
no piece of such a vocabulary continues a word into a space, which is checked when it is loaded.

Applying every occurrence of a pair at once equals applying them one by one unless a merge makes a
pair of the same or a lower rank.  Sequences where that happens are merged again from the start, one
pair at a time in the library's order (lowest rank, then leftmost).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, pieces, texts_of

SPACE = "▁"
#: entries of a task's memo of pre-token counts before it starts afresh; a memo, not a bound on the data
MEMO_ENTRIES = 1_200_000
MEMO_CHARS = 48
NO_RANK = np.iinfo(np.int32).max

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


class PieceVocabulary:
    """Symbols, pair ranks and symbol sizes of a piece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [i for i in range(model.vocab_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
        skipped = set(special)
        names = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if i not in skipped}
        if sum(map(model.is_byte, special)) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        if any(re.search(f"[^{SPACE}]{SPACE}", n) for n in names):
            raise ValueError("a piece runs from a word into a space")
        if model.encode("①  ", out_type=str)[-1] != " " and " " in names:
            raise ValueError("the vocabulary rewrites texts before it splits them")
        letters = sorted({c for n in names for c in n})
        self.ids = {s: i for i, s in enumerate(dict.fromkeys([*letters, *names]))}
        # symbols 0-3 past the known ones: unknown characters of 1 to 4 bytes
        self.unknown = len(self.ids) - 1
        size = len(self.ids) + 4
        self.tokens = np.ones(size, dtype=np.int64)
        for c in letters:
            if c not in names:
                self.tokens[self.ids[c]] = len(c.encode())
        self.tokens[-4:] = (1, 2, 3, 4)
        ranks = {score: i for i, score in enumerate(sorted(set(names.values()), reverse=True))}
        rules = {}
        for name, score in names.items():
            for at in range(1, len(name)):
                left, right = self.ids.get(name[:at]), self.ids.get(name[at:])
                if left is not None and right is not None:
                    rules[left * size + right] = (ranks[score], self.ids[name])
        self.size = size
        self.keys = np.array(sorted(rules), dtype=np.int64)
        values = [rules[int(k)] for k in self.keys]
        self.ranks = np.array([v[0] for v in values], dtype=np.int32)
        self.results = np.array([v[1] for v in values], dtype=np.int32)
        self.rules = rules

    def symbols(self, text: str) -> list[int]:
        known = self.ids
        return [known[c] if c in known else self.unknown + len(c.encode("utf-8", "replace")) for c in text]

    def pair_rules(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; pairs without a rule get NO_RANK."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == wanted
        return np.where(found, self.ranks[at], NO_RANK).astype(np.int32), self.results[at]

    def merge_one_by_one(self, symbols: list[int]) -> int:
        """Tokens of one sequence, merged in the library's order."""
        sym, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                rule = self.rules.get(sym[i] * self.size + sym[after[i]])
                if rule:
                    heapq.heappush(waiting, (rule[0], i, sym[i], sym[after[i]], rule[1]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, left, right, result = heapq.heappop(waiting)
            if sym[i] != left or after[i] >= n or sym[after[i]] != right:
                continue
            gone = after[i]
            sym[i], sym[gone], after[i] = result, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return int(sum(self.tokens[s] for s in sym if s >= 0))

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each pre-token, merged rank by rank over all of them at once."""
        out = np.zeros(len(texts), dtype=np.int64)
        lists = [self.symbols(t) for t in texts]
        lengths = np.array([len(x) for x in lists], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        sym = np.fromiter((s for x in lists for s in x), dtype=np.int32, count=int(lengths.sum()))
        last_rank = np.full(len(texts), -1, dtype=np.int32)
        redo = np.zeros(len(texts), dtype=bool)
        rank, result = self._ranks_of(sym, owner)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            names = owner[starts]
            lowest = np.minimum.reduceat(rank, starts)
            # a pair of no higher rank than the last one applied: its order matters
            redo[names[(lowest <= last_rank[names]) & (lowest != NO_RANK)]] = True
            done = (lowest == NO_RANK) | redo[names]
            per_seq = np.diff(np.r_[starts, len(sym)])
            if done.any():
                ended = np.repeat(done, per_seq)
                np.add.at(out, owner[ended], self.tokens[sym[ended]])
                stay = ~ended
                sym, owner, rank, result = sym[stay], owner[stay], rank[stay], result[stay]
                last_rank[names[~done]] = lowest[~done]
                lowest, per_seq = lowest[~done], per_seq[~done]
                if not len(sym):
                    break
            else:
                last_rank[names] = lowest
            chosen = rank == np.repeat(lowest, per_seq)
            # overlapping pairs: every second one of a run, from the left
            at = np.flatnonzero(chosen)
            run_start = np.r_[True, np.diff(at) > 1]
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
            # the merged symbol beside its right neighbour of this moment, which may be merged away in the same round
            beside = at + 2
            inside = np.flatnonzero(beside < len(sym))
            inside = inside[owner[beside[inside]] == owner[at[inside]]]
            if len(inside):
                ranks_beside, _ = self.pair_rules(result[at[inside]], sym[beside[inside]])
                redo[owner[at[inside]][ranks_beside <= rank[at[inside]]]] = True
            sym[at] = result[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            touched = np.zeros(int(moved[-1]) + 1, dtype=bool)
            touched[moved[at]] = True
            touched[np.maximum(moved[at] - 1, 0)] = True
            sym, owner, rank, result = sym[keep], owner[keep], rank[keep], result[keep]
            self._refresh(sym, owner, rank, result, np.flatnonzero(touched))
        for i in np.flatnonzero(redo):
            out[i] = self.merge_one_by_one(lists[i])
        return out

    def _ranks_of(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.full(len(sym), NO_RANK, dtype=np.int32)
        result = np.zeros(len(sym), dtype=np.int32)
        self._refresh(sym, owner, rank, result, np.arange(len(sym)))
        return rank, result

    def _refresh(self, sym, owner, rank, result, at) -> None:
        """Rank and result of the pairs that begin at the given places."""
        rank[at] = NO_RANK
        at = at[at + 1 < len(sym)]
        at = at[owner[at] == owner[at + 1]]
        rank[at], result[at] = self.pair_rules(sym[at], sym[at + 1])


class TokenCounter:
    """Counts tokens of texts; remembers the pre-tokens it has seen."""

    def __init__(self, path: str):
        self.vocabulary = PieceVocabulary(path)
        self.memo: dict[str, int] = {}
        # a line feed that no piece holds ends every merge, so lines can be cut apart
        self.lines_apart = "\n" not in self.vocabulary.ids

    def split(self, text: str) -> list[str]:
        """Pre-tokens.  A word is listed without the space in front of it unless a line feed stands there."""
        if self.lines_apart:
            text = text.replace("\n", " \n")
        return text.split(" ")

    def general(self, text: str) -> int:
        """Texts with runs of spaces or the space mark itself."""
        words = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", (" " + text).replace(" ", SPACE))
        return int(self.vocabulary.counts(words).sum())

    def count(self, texts: list[str]) -> list[int]:
        plain = [bool(t) and SPACE not in t for t in texts]
        parts = [self.split(t) if p else [] for t, p in zip(texts, plain, strict=True)]
        for i, words in enumerate(parts):
            if "" in words:
                plain[i], parts[i] = False, []
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = {}
        memo = self.memo
        fresh = [w for w in set().union(*parts) if w not in memo]
        lengthy = []
        if fresh:
            lead = [w if w[0] == "\n" and self.lines_apart else SPACE + w for w in fresh]
            memo.update(zip(fresh, self.vocabulary.counts(lead).tolist(), strict=True))
            lengthy = [w for w in fresh if len(w) > MEMO_CHARS]
        out = []
        for text, fast, words in zip(texts, plain, parts, strict=True):
            if fast:
                # a text that opens with a line feed still has the mark in front of it
                extra = 1 if words[0][0] == "\n" and self.lines_apart else 0
                out.append(extra * self.mark() + sum(map(memo.__getitem__, words)))
            else:
                out.append(self.general(text) if text else 0)
        for w in lengthy:
            del memo[w]
        return out

    def mark(self) -> int:
        return int(self.vocabulary.counts([SPACE])[0])


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter per worker process and vocabulary."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs, in one narrow pass.

    A null or empty text has no bytes and no tokens; it is not over the limit.  A null doc_id stays null,
    repeated rows give repeated results, an empty table an empty one, and columns besides doc_id and
    text are not read.  vocabulary is the path of a piece model that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = counter(vocabulary).count(texts_of(batch))
            tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "n_bytes"), tokens, pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    read = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    return read.mapInArrow(run, SCHEMA)
