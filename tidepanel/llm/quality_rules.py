"""Rules on a text's own repetition, found with suffix arrays over its words.

All texts of an Arrow chunk share one array of word numbers, made distinct by document, so repeats never
cross documents. Prefix doubling sorts the suffixes and only those still tied are sorted again; the rank
tables of the doublings then give the longest common prefix of neighbours. A suffix's longest repeat is
the larger of its two neighbours' prefixes: the occurrences of the maximal repeats are exactly these spans
where the span does not extend to the left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidepanel.llm.common import fields, map_texts

MIN_WORDS = 50
#: A repeat counts from this many words on.
MIN_REPEAT = 8
#: Limit on the share of words inside repeats, and on the longest repeat in words.
MAX_COVERED = 0.3
MAX_REPEAT = 60

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
RESULT = fields(
    n_words="long", word_chars="long", n_symbols="long", n_dup_lines="long", n_repeat_words="long",
    covered_words="long", longest_repeat="long", base_failed="boolean", kept="boolean",
)


def longest_repeats(tokens: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run from it that also starts elsewhere.

    ``tokens`` must end with a value that occurs once.
    """
    n = len(tokens)
    _, first, size = np.unique(tokens, return_inverse=True, return_counts=True)
    starts = np.cumsum(size) - size
    rank = starts[first].astype(np.int64)
    sa = np.argsort(rank, kind="stable")
    levels, depth = [rank.copy()], 1
    slots = np.flatnonzero((size > 1)[first[sa]])
    while len(slots):
        act = sa[slots]
        major, minor = rank[act], rank[np.minimum(act + depth, n - 1)]
        order = np.argsort(major * n + minor, kind="stable")
        act, major, minor = act[order], major[order], minor[order]
        sa[slots] = act
        new = np.r_[True, (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])]
        group = np.cumsum(new) - 1
        rank[act] = slots[np.flatnonzero(new)][group]
        slots = slots[(np.bincount(group) > 1)[group]]
        depth *= 2
        levels.append(rank.copy())
    left, right = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero((left < n) & (right < n) & (levels[k][np.minimum(left, n - 1)] == levels[k][np.minimum(right, n - 1)]))
        left[same] += 1 << k
        right[same] += 1 << k
        lcp[same] += 1 << k
    out = np.zeros(n, dtype=np.int64)
    np.maximum.at(out, sa[:-1], lcp)
    np.maximum.at(out, sa[1:], lcp)
    return out


def _covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Positions inside any repeat of ``least`` words or more."""
    n = len(longest)
    maximal = longest >= least
    maximal[1:] &= longest[1:] >= longest[:-1]  # a span that extends to the left lies in its predecessor's
    at = np.flatnonzero(maximal)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + longest[at], n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _rules(min_repeat: int, max_covered: float, max_repeat: int):
    def work(texts: list) -> list:
        n_words, chars, symbols, dup_lines, ids, doc = [], [], [], [], [], []
        for i, text in enumerate(texts):
            text = text or ""
            data = text.encode()
            words = data.split()
            seen: dict[bytes, int] = {}
            ids += [seen.setdefault(w, len(seen)) for w in words]
            ids.append(-1)
            n_words.append(len(words))
            chars.append(len(text) - (len(data) - len(data.translate(None, SPACES))))
            symbols.append(len(data) - len(data.translate(None, SYMBOLS)))
            lines = [line for line in data.split(b"\n") if line.split()] if b"\n" in data else []
            dup_lines.append(len(lines) - len(set(lines)))
        count = np.asarray(n_words, dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), count + 1)
        local = np.asarray(ids, dtype=np.int64)
        end = local < 0
        # Distinct by document; each end has a number of its own.
        tokens = np.where(end, -1 - doc, doc * (int(count.max()) + 1) + local)
        longest = longest_repeats(tokens)
        three, long = _covered(longest, 3), _covered(longest, min_repeat)
        per = lambda mask: np.bincount(doc, weights=mask, minlength=len(texts)).astype(np.int64)
        repeat, covered = per(three), per(long)
        top = np.zeros(len(texts), dtype=np.int64)
        np.maximum.at(top, doc, longest)
        failed = (count < MIN_WORDS) | (100 * repeat > 50 * count)
        kept = ~failed & (covered <= max_covered * count) & (top <= max_repeat)
        return [count, chars, symbols, dup_lines, repeat, covered, top, failed, kept]

    return work


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    carry: list[str] | None = None,
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """Carried columns (default ``doc_id``) and the figures of ``RESULT``, one row per input row.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike and each
    is returned. An empty table gives an empty result. Only ``carry`` and ``text`` are read.
    """
    prepare = lambda: _rules(min_repeat, max_covered, max_repeat)
    return map_texts(docs, text, RESULT, prepare, ["doc_id"] if carry is None else carry)
