"""Structured parts of free text: JSON objects, tool calls, chat masks."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_CALL = r"(?s)<tool_call>\s*<function=([^>]+)>(.*?)</function>\s*</tool_call>"
_PARAMETER = r"(?s)<parameter=([^>]+)>(.*?)</parameter>"

#: Fixed value: a JSON scalar that stands for itself.
_SCALAR = re.compile(r"(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)\Z")
_STRICT = json.JSONDecoder()


class _Tolerant:
    """Reads one JSON object of a text that a model wrote.

    Beside JSON it takes: a comma before a closing bracket; no comma where the
    next member starts a line of its own; and, for a member that has its line
    to itself, a bare value up to the end of that line, which becomes a string.
    """

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _skip(self) -> str:
        """Passes white space and tells the character behind it."""
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def _take(self, wanted: str) -> bool:
        if self._skip() != wanted:
            return False
        self.at += 1
        return True

    def _item(self):
        value, self.at = _STRICT.raw_decode(self.text, self.at)
        return value

    def value(self):
        kind = self._skip()
        if kind == "{":
            return self.object()
        if kind == "[":
            return self.list()
        return self._item()

    def list(self) -> list:
        self.at += 1
        out: list = []
        while not self._take("]"):
            out.append(self.value())
            if not self._take(",") and self._skip() != "]":
                raise ValueError("no comma in a list")
        return out

    def object(self) -> dict:
        self.at += 1
        out: dict = {}
        while not self._take("}"):
            self._skip()
            own_line = not self.text[self.text.rfind("\n", 0, self.at) + 1 : self.at].strip()
            name = self._item()
            if not isinstance(name, str) or not self._take(":"):
                raise ValueError("no member")
            out[name] = self._member() if own_line else self.value()
            before = self.at
            if not self._take(",") and self._skip() != "}" and "\n" not in self.text[before : self.at]:
                raise ValueError("no comma between members of a line")
        return out

    def _member(self):
        """A value, or the rest of the line where that isn't one."""
        stop = self.text.find("\n", self.at)
        stop = len(self.text) if stop < 0 else stop
        rest = self.text[self.at : stop].strip()
        bare = rest.removesuffix(",").rstrip()
        if not bare or bare[0] in '"{[' or _SCALAR.match(bare):
            return self.value()
        self.at = self.text.rindex(",", 0, stop) if rest.endswith(",") else stop
        return bare


def _relaxed(text: str) -> dict | None:
    """The object that is the whole of ``text``: as JSON or as a Python literal, else read with tolerance."""
    try:
        value = ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        value = None
    if isinstance(value, dict):
        return value
    reader = _Tolerant(text)
    try:
        value = reader.value()
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) and not reader._skip() else None


def last_object(text: str | None) -> dict | None:
    """The JSON object that ends last in ``text``, the widest of those; a malformed one at the last brace is read with tolerance."""
    if not text:
        return None
    found, end, at = None, 0, text.find("{")
    while at >= 0:
        try:
            found, end = _STRICT.raw_decode(text, at)
            at = text.find("{", end)  # what lies inside ends earlier
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
    last = text.rfind("}") + 1
    at = text.find("{") if end < last else -1
    while 0 <= at < last:
        whole = _relaxed(text[at:last])
        if whole is not None:
            return whole
        at = text.find("{", at + 1)
    return found


def _canonical(text: str | None) -> str | None:
    found = last_object(text)
    return None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def last_json(text: Column) -> Column:
    """``last_object`` as JSON text with sorted names, or null. Texts without a brace aren't parsed."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_canonical)

    return run(F.when(text.contains("{"), text))


def tool_calls(text: Column, names: list[str]) -> Column:
    """struct(text, calls array of (name, input map)): calls of known tools, and the text without them.

    Of parameters named twice the last counts; null texts give no calls and a null text.
    """

    def inputs(body: Column) -> Column:
        keys, values = (F.regexp_extract_all(body, F.lit(_PARAMETER), i) for i in (1, 2))
        pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), F.regexp_replace(v, r"^\s+|\s+$", "").alias("value")))
        return let(pairs, lambda ps: F.map_from_entries(F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"]))))

    calls, between = F.regexp_extract_all(text, F.lit(_CALL), 0), F.split(text, _CALL, -1)
    known = F.lit(r"^<tool_call>\s*<function=(?:" + "|".join(rf"\Q{n}\E" for n in names) + ")>")
    refused = F.transform(calls, lambda c: F.when(F.rlike(c, known), "").otherwise(c))
    visible = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get(refused, i), F.lit("")))), "")
    accepted = F.filter(calls, lambda c: F.rlike(c, known))
    parsed = F.transform(accepted, lambda c: F.struct(F.regexp_extract(c, _CALL, 1).alias("name"), inputs(F.regexp_extract(c, _CALL, 2)).alias("input")))
    return F.struct(visible.alias("text"), parsed.alias("calls"))


def chat_mask(messages: Column, header: Column | int = 0) -> Column:
    """struct(tokens, mask) of array<struct<role, ids, train>>: one where the model is trained.

    Only ids of assistant messages after the first ``header`` ids (their template's opening) are trained, and only where
    ``train`` isn't 0. Null ids count as none.
    """
    ids = lambda m: F.coalesce(m["ids"], F.array().cast("array<int>"))
    skip = F.lit(header) if isinstance(header, int) else header

    def mask(m: Column) -> Column:
        on = (m["role"] == "assistant") & (F.coalesce(m["train"], F.lit(1)) == 1)
        return F.transform(ids(m), lambda _, i: F.when(on & (i >= skip), 1).otherwise(0))

    return F.struct(F.flatten(F.transform(messages, ids)).alias("tokens"), F.flatten(F.transform(messages, mask)).alias("mask"))


def response_part(tokens: Column, mask: Column) -> Column:
    """struct(tokens, response_length, mask): the mask from its first 1 on; its length is 0 where nothing is trained."""
    at = F.array_position(mask, 1).cast("int")
    n = F.when(at > 0, F.size(mask) - at + 1).otherwise(0)
    return F.struct(tokens.alias("tokens"), n.alias("response_length"), F.slice(mask, F.greatest(at, F.lit(1)), n).alias("mask"))
