"""Decoding that built-in functions don't have, as Arrow-batched functions."""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

ALPHABET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
#: Groups of four characters that make a stretch worth decoding.
LEAST_QUADS = 4
#: What decoded text may hold: ASCII that can be shown, and these controls.
SHOWN = frozenset(map(chr, range(0x20, 0x7F))) | frozenset("\t\r\n")
#: Fixed value: how decoded text is marked.
MARK = " [DECODED_B64: {}] "


def stretches(line: str) -> Iterator[tuple[int, int]]:
    """Where whole groups of four base64 characters stand, enough of them in a row, with a padded group at the end if there is one."""
    at, n = 0, len(line)
    while at < n:
        end = at
        while end < n and line[end] in ALPHABET:
            end += 1
        rest = (end - at) % 4
        if end - at - rest >= 4 * LEAST_QUADS:
            pad = 4 - rest if rest in (2, 3) else 0
            yield (at, end + pad) if pad and line[end : end + pad] == "=" * pad else (at, end - rest)
        at = max(end, at + 1)


def decoded(line: str) -> str:
    """URL-decoded; stretches of base64 that stand for text that can be shown are shown as that text."""
    plain, out, at = unquote(line), [], 0
    for begin, end in stretches(plain):
        try:
            text = binascii.a2b_base64(plain[begin:end]).decode("utf-8")
        except (binascii.Error, UnicodeDecodeError):
            continue
        if SHOWN.issuperset(text):
            out += [plain[at:begin], MARK.format(text)]
            at = end
    return "".join([*out, plain[at:]])


def encoded(text: str) -> str:
    return base64.b64encode(text.encode()).decode()


def deobfuscate(line: Column) -> Column:
    @pandas_udf("string")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: x if x is None else decoded(x))

    return run(line)
