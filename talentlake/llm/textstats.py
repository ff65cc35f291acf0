"""Counts over whole texts, a batch of documents at a time in flat numpy arrays."""

from __future__ import annotations

import numpy as np

from talentlake.llm.common import WordHash, held

#: The symbol characters of the quality contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def word_arrays(texts: list[str | None], lower: bool = False) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text (cut at ASCII white space), their hashes in one array, and each text's first place in it."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words = [(r.lower() if lower else r).split() for r in raw]
    get = held(("words",), WordHash).__getitem__
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    hashes = np.fromiter((h for w in words for h in map(get, w)), np.int64, int(starts[-1]))
    return words, hashes, starts


def repeated_words(hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text: words inside windows that occur twice or more in that text, the first occurrence included."""
    n, docs = len(hashes), len(starts) - 1
    if n < window:
        return np.zeros(docs, np.int64)
    doc = np.repeat(np.arange(docs), np.diff(starts))
    h = hashes.view(np.uint64)
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    if not len(at):
        return np.zeros(docs, np.int64)
    key = doc[at].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    for k in range(window):
        key = (key ^ h[at + k]) * _MIX[k % len(_MIX)]
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + window, -1)
    inside = np.cumsum(cover[:n]) > 0
    return np.bincount(doc[inside], minlength=docs)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def base_counts(texts: list[str | None]) -> list[list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    _, hashes, starts = word_arrays(texts)
    sizes = np.diff(starts)
    plain = [t or "" for t in texts]
    chars = [len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")) for t in plain]
    symbols = [sum(map(t.count, SYMBOLS)) for t in plain]
    return [sizes.tolist(), chars, symbols, [duplicate_lines(t) for t in plain], repeated_words(hashes, starts).tolist()]


#: Inputs of the quality classifier.
FEATURES = (
    "log_words", "word_length", "symbol_share", "bang_share", "upper_share", "digit_share", "pipe_share", "dup_line_share", "repeat_share",
    "distinct_share", "stop_share", "comma_share", "line_words", "short_line_share", "short_word_share", "long_word_share", "accent_share", "odd_share", "capital_word_share", "sentence_words",
)


def features(texts: list[str | None]) -> np.ndarray:
    """FEATURES of each text, one row per text; a null or empty text has zeros."""
    words, hashes, starts = word_arrays(texts)
    base = np.array(base_counts(texts), np.float64).T.reshape(len(texts), 5)
    repeat = base[:, 4]
    out = np.zeros((len(texts), len(FEATURES)))
    for i, (t, w) in enumerate(zip(texts, words, strict=True)):
        if not t:
            continue
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        by = np.bincount(raw, minlength=256)
        n, chars = max(1, len(w)), max(1, len(raw))
        lines = [x for x in t.split("\n") if x.strip()]
        sizes = np.fromiter(map(len, w), np.int64, len(w)) if w else np.zeros(1, np.int64)
        upper, letters = by[65:91].sum(), max(1, by[65:91].sum() + by[97:123].sum())
        own = hashes[starts[i] : starts[i + 1]]
        line_words = [x.count(" ") + 1 for x in lines]
        caps = sum(x[:1].isupper() for x in w)
        stops = by[46] + by[33] + by[63]
        out[i] = (
            np.log1p(len(w)), base[i, 1] / n, base[i, 2] / n, by[33] / n, upper / letters, by[48:58].sum() / chars, by[124] / n, base[i, 3] / max(1, len(lines)), repeat[i] / n,
            len(np.unique(own)) / n, by[46] / n, by[44] / n, np.mean(line_words) if lines else 0, sum(x < 4 for x in line_words) / max(1, len(lines)),
            (sizes <= 3).mean(), (sizes >= 12).mean(), by[195:].sum() / chars, (by[35:39].sum() + by[42] + by[60:63].sum() + by[64] + by[91:97].sum() + by[123:127].sum()) / chars, caps / n, n / max(1, stops),
        )
    return out
