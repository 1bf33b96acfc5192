"""Token ids and training masks of chats: messages are rendered by a template, encoded, and masked by family."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chats that become Python objects at once.
BATCH_ROWS = 256


@dataclass(frozen=True)
class Template:
    """How a message becomes text. ``markers`` are single tokens, added behind the vocabulary where it lacks them."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    line: str = "\n"
    tool_open: str = "<tool_response>\n"
    tool_close: str = "\n</tool_response>"
    thought: str = "<think>\n"
    default_system: str | None = None

    @property
    def markers(self) -> list[str]:
        return [self.start, self.end]

    def opening(self, role: str) -> str:
        return f"{self.start}{role}{self.line}"

    def text(self, role: str, content: str) -> str:
        if role == "tool":
            role, content = "user", f"{self.tool_open}{content}{self.tool_close}"
        return f"{self.opening(role)}{content}{self.end}{self.line}"


CHATML = Template()


@cache
def coder(path: str, markers: tuple[str, ...]):
    """The tokenizer of a file, whose special tokens but the markers are ordinary text."""
    from tokenizers import AddedToken, Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    found.add_tokens([AddedToken(m, normalized=False) for m in markers])
    found.encode_special_tokens = True
    return found


def _checked(messages: list[dict], template: Template) -> list[dict]:
    """Messages with role, content, train and ids; a system message that isn't first, or another role, raises."""
    out = []
    for k, m in enumerate(messages):
        role = m.get("role") or "assistant"
        if role not in ("system", "user", "assistant", "tool"):
            raise ValueError(f"no template for the role {role!r}")
        if role == "system" and k:
            raise ValueError("a system message must be the first")
        train = role == "assistant" and m.get("train") in (None, 1)
        out.append({"role": role, "content": m.get("content") or "", "train": train, "ids": list(m.get("ids") or [])})
    if template.default_system is not None and (not out or out[0]["role"] != "system"):
        out.insert(0, {"role": "system", "content": template.default_system, "train": False, "ids": []})
    return out


Encode = Callable[[str], list[int]]


def _spliced(messages: list[dict], template: Template, tokens) -> tuple[list[int], list[int]]:
    """Each message by itself, recorded ids as they are; an assistant's whole message is trained, its opening too."""
    encode: Encode = lambda text: tokens.encode(text, add_special_tokens=False).ids
    end, out, mask = tokens.token_to_id(template.end), [], []
    for m in messages:
        if m["role"] == "assistant" and m["ids"]:
            closed = m["ids"] if m["ids"][-1] == end else [*m["ids"], end]
            ids = [*encode(template.opening("assistant")), *closed, *encode(template.line)]
        else:
            ids = encode(template.text(m["role"], m["content"]))
        out += ids
        mask += [int(m["train"])] * len(ids)
    return out, mask


def _headed(messages: list[dict], template: Template, tokens) -> tuple[list[int], list[int]]:
    """Each message by itself; of a trained one all but the tokens of its opening."""
    head = len(tokens.encode(template.opening("assistant"), add_special_tokens=False).ids)
    out, mask = [], []
    for m in messages:
        ids = tokens.encode(template.text(m["role"], m["content"]), add_special_tokens=False).ids
        out += ids
        mask += [int(m["train"] and k >= head) for k in range(len(ids))]
    return out, mask


def _rendered(messages: list[dict], template: Template, tokens) -> tuple[list[int], list[int]]:
    """The whole chat as one text; tokens that touch a trained span of characters.

    A span runs from behind the opening, and the mark of a thought if it comes
    first, to the end of the message and its line.
    """
    texts = [template.text(m["role"], m["content"]) for m in messages]
    bounds = list(accumulate(map(len, texts), initial=0))
    spans = []
    for m, text, at in zip(messages, texts, bounds, strict=False):
        if m["train"]:
            skip = len(template.opening("assistant"))
            skip += len(template.thought) if text.startswith(template.thought, skip) else 0
            spans.append((at + skip, at + len(text)))
    coded = tokens.encode("".join(texts), add_special_tokens=False)
    ends = [b for _, b in spans]

    def touches(a: int, b: int) -> bool:
        k = bisect.bisect_right(ends, a)  # the first span that ends behind a
        return a < b and k < len(spans) and spans[k][0] < b

    return coded.ids, [int(touches(a, b)) for a, b in coded.offsets]


def _last_answer(messages: list[dict], template: Template, tokens) -> tuple[list[int], list[int]]:
    """The first message as a prompt, then the last one's bare text, which alone is trained."""
    encode: Encode = lambda text: tokens.encode(text, add_special_tokens=False).ids
    first = 2 if template.default_system is not None and len(messages) > 1 else 1
    prompt = encode("".join(template.text(m["role"], m["content"]) for m in messages[:first]) + template.opening("assistant"))
    last = messages[-1] if messages else {"content": "", "train": False}
    answer = encode(last["content"])
    return prompt + answer, [0] * len(prompt) + [int(last["train"])] * len(answer)


FAMILIES = {"spliced": _spliced, "headed": _headed, "rendered": _rendered, "last_answer": _last_answer}


def mask_of(messages: list[dict], family: str, path: str, template: Template = CHATML) -> tuple[list[int], list[int]]:
    """(token ids, mask) of one chat."""
    if family not in FAMILIES:
        raise ValueError(f"{family!r} is no family of masks; there are {sorted(FAMILIES)}")
    return FAMILIES[family](_checked(messages, template), template, coder(path, tuple(template.markers)))


def template_masks(chats: DataFrame, family: str, path: str, messages_col: str = "messages", template: Template = CHATML, texts: bool = False) -> DataFrame:
    """``chats`` with tokens, loss_mask and response_length in place of its messages: array<struct<role, content[, train, ids]>>.

    With ``texts`` also text and trained: what all and the trained tokens decode to.

    The mask is 1 on the tokens that ``family`` trains: ``spliced`` (whole
    assistant messages, recorded ids kept), ``headed`` (without their opening),
    ``rendered`` (by the characters that a token covers in the whole text) or
    ``last_answer``. ``train`` other than null or 1 leaves a turn out.
    ``response_length`` counts from the first trained token on. A null or empty
    chat has no tokens but those of the template's own system message. A role
    that the template lacks, or a late system message, raises.
    """
    if family not in FAMILIES:
        raise ValueError(f"{family!r} is no family of masks; there are {sorted(FAMILIES)}")
    rest = [c for c in chats.columns if c != messages_col]
    flat = chats.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)), F.col(messages_col).alias("messages"))
    kinds = {"tokens": "array<int>", "loss_mask": "array<int>", "response_length": "int"} | ({"text": "string", "trained": "string"} if texts else {})
    schema = flat.drop("messages").withColumns({k: F.lit(None).cast(t) for k, t in kinds.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                made = [mask_of(m or [], family, path, template) for m in part.column(len(rest)).to_pylist()]
                lengths = [len(mask) - mask.index(1) if 1 in mask else 0 for _, mask in made]
                kind = pa.list_(pa.int32())
                new = [pa.array([ids for ids, _ in made], kind), pa.array([mask for _, mask in made], kind), pa.array(lengths, pa.int32())]
                if texts:
                    tokens = coder(path, tuple(template.markers))
                    decode = lambda ids: tokens.decode(ids, skip_special_tokens=False)
                    new += [pa.array([decode(ids) for ids, _ in made]), pa.array([decode([i for i, m in zip(ids, mask, strict=True) if m]) for ids, mask in made])]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *new], schema.names)

    return flat.mapInArrow(run, schema).toDF(*rest, *kinds)


def chats_of(turns: DataFrame, chat: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(chat, messages): the turns of each chat in order; later system turns join the user's side."""
    one = F.struct(turn, F.col(role).alias("role"), F.col(text).alias("content"))
    rows = turns.groupBy(chat).agg(F.array_sort(F.collect_list(one)).alias("m"))
    message = lambda m, k: F.struct(F.when((m["role"] == "system") & (k > 0), "user").otherwise(m["role"]).alias("role"), m["content"].alias("content"))
    return rows.select(chat, F.transform("m", message).alias("messages"))
