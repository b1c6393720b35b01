"""Quality rules by compression: zstandard ratios of whole texts and of fixed chunks against bands for their length.

Repetitive text compresses far better than prose of its length, random characters hardly at all. Short texts
compress less than long ones, as the coder has seen little yet, so each length has its own band. Chunks of a fixed
length find a repetitive or random part that the ratio of a long text evens out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

LEVEL = 3
#: (least bytes, lowest ratio, highest ratio) of a whole text. Prose lies between 1.3 and 3 in all of them; base64 and
#: other random letters stay near 1.3, hexadecimal digits reach 2, and a page that is said twice about doubles its ratio.
BANDS = ((0, 0.0, 2.5), (256, 1.1, 3.0), (1024, 1.25, 3.5), (4096, 1.35, 4.0), (16384, 1.4, 5.0), (65536, 1.45, 6.0))
#: Bytes of a chunk; a shorter rest is judged with the whole text only.
CHUNK = 4096
CHUNK_BAND = (1.35, 4.0)
#: The share of a text's chunks that may lie outside their band.
CHUNKS_OUTSIDE = 0.2
#: Base rules, as the contract has them.
LEAST_WORDS = 50
MOST_REPEATED = 50

_SPACES = b" \t\n\r\x0b\f"
_SYMBOLS = b"#*$%&|<>"

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_bytes long, ratio double, n_chunks long, chunks_outside long, kept boolean"
)


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three that occurs twice or more; the first occurrence counts as well."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    _, pairs = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)
    _, windows, times = np.unique(pairs * len(number) + ids[2:], return_inverse=True, return_counts=True)
    found = times[windows] > 1
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= found
    return int(inside.sum())


def base_counts(text: str, body: bytes) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, repeated words."""
    words = body.split()
    lines = [line for line in body.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - (len(body) - len(body.translate(None, _SPACES))),
        len(body) - len(body.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def band(n_bytes: int) -> tuple[float, float]:
    """Lowest and highest ratio of a text of *n_bytes*."""
    return next((low, high) for least, low, high in reversed(BANDS) if n_bytes >= least)


def ratios(body: bytes, compressor) -> tuple[float, list[float]]:
    """The ratio of the whole text and those of its full chunks; 0 for an empty text."""
    ratio = lambda part: len(part) / len(compressor.compress(part))
    whole = ratio(body) if body else 0.0
    return whole, [ratio(body[at : at + CHUNK]) for at in range(0, len(body) - CHUNK + 1, CHUNK)]


def verdict(n_bytes: int, whole: float, chunks: list[float]) -> tuple[bool, int]:
    """Whether the ratios lie inside their bands, and the number of chunks outside."""
    low, high = band(n_bytes)
    outside = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks)
    return low <= whole <= high and outside <= CHUNKS_OUTSIDE * len(chunks), outside


def judge(text: Column) -> Column:
    """A struct of the base counts, the ratios and the verdict for each whole text.

    Null counts as the empty text: no words, ``base_failed`` and so not kept. Texts of any length are judged whole,
    one at a time; equal texts get equal answers, and an empty table gives an empty result.
    """

    @pandas_udf(f"struct<{FIELDS.replace(' ', ': ').replace(',:', ',')}>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        names = [field.split()[0] for field in FIELDS.split(", ")]
        for batch in batches:
            rows = []
            for text in batch:
                text = text or ""
                body = text.encode()
                counts = base_counts(text, body)
                failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
                whole, chunks = ratios(body, compressor)
                inside, outside = verdict(len(body), whole, chunks)
                rows.append((*counts, failed, len(body), whole, len(chunks), outside, inside and not failed))
            yield pd.DataFrame(rows, columns=names)

    return judged(text)
