"""Column functions on texts: tokens, keywords, answers, labels. All run inside the JVM, but for ``compression``."""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPRESS = {
    "zlib": zlib.compress,
    "gzip": lambda raw, level: gzip.compress(raw, compresslevel=level),
    "bz2": bz2.compress,
    "lzma": lambda raw, level: lzma.compress(raw, preset=level),
}

#: What a public card must not tell, by name of the leak.
LEAKAGE = {
    "node_id": r"(?i)\bnode[-_ ]?id\b",
    "terminal reward": r"(?i)\b(?:terminal|ground[- ]truth|gt)[-_ ]?rewards?\b",
    "hidden test": r"(?i)\bhidden tests?\b",
    "golden patch": r"(?i)\bgolden (?:patch|solution)\b",
    "experiment identity": r"(?i)\b(?:this|the) experiment\b|\bv\d{2,3}\b",
    "instance identity": r"(?i)\binstance[-_ ]?id\b",
}

#: Fixed value: a script name whose counter before .py is generated; the name without it is group 1.
COUNTER = r"(?i)\b((?:debug|test|issue|apply[_-]?fix|fix|script|attempt|try)(?:[_-][a-z]+)*[_-]?)\d+(?=\.py\b)"

#: Phrasings that name a choice, looked for in this order.
CHOICES = [
    r"(?i)(?:answer|option|choice)\s*(?:is|:)?\s*([A-Z])",
    r"(?i)([A-Z])\s*(?:is\s*(?:the)?\s*correct)",
    r"(?i)final\s*(?:answer|option)\s*(?:is|:)?\s*([A-Z])",
]

#: The mark of a cut text, and the characters of a label.
TRUNCATED = "\n[... Observation truncated due to length ...]\n"
LABEL = r"[^A-Za-z0-9_.:/-]+"


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def retrieval_tokens(text: Column) -> Column:
    """Identifiers and numbers, each with its parts at ./:_- and at camel humps, lower-cased, longer than one."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_./:-]*|[0-9]+)"), 1)

    def parts(t: Column) -> Column:
        cut = F.array_remove(F.split(t, r"[./:_-]+"), "")
        whole = F.array(t)
        return F.concat(whole, F.when(F.size(cut) > 1, cut).otherwise(F.filter(cut, lambda x: x != t)))

    pieces = F.flatten(F.transform(found, parts))
    humps = F.flatten(F.transform(pieces, lambda p: F.split(p, r"(?<=[a-z0-9])(?=[A-Z])")))
    return F.filter(F.transform(humps, F.lower), lambda x: F.length(x) > 1)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t-\r]+", " "))


def dedupe_fold(values: Column) -> Column:
    """Trimmed, blanks dropped, the first of each lower-cased form, in order: the heads of the sorted forms' runs."""
    kept = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    forms = F.array_sort(F.transform(kept, lambda v, i: F.struct(F.lower(v).alias("form"), i.alias("at"), v.alias("text"))))
    heads = let(forms, lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["form"] != x["form"])))
    return F.transform(F.array_sort(F.transform(heads, lambda x: F.struct(x["at"], x["text"]))), lambda x: x["text"])


def clean_keyword(phrase: Column, forbidden: str, generic: list[str]) -> Column:
    """The phrase with single spaces, or null: outside 2..160 characters or 1..12 keyword tokens, forbidden or generic."""
    p = squeeze(phrase)
    words = F.size(F.regexp_extract_all(p, F.lit("([A-Za-z0-9_./:-]+)"), 1))
    bad = ~F.length(p).between(2, 160) | p.rlike(forbidden) | F.lower(p).isin(generic) | ~words.between(1, 12)
    return F.when(~bad, p)


def phrase_match(phrase: Column, view: Column) -> Column:
    """The phrase is part of the view, or four fifths of its terms of three letters or more are."""
    p, v = F.lower(squeeze(phrase)), F.lower(squeeze(view))
    terms = F.filter(F.regexp_extract_all(p, F.lit("([a-z0-9_./:-]+)"), 1), lambda t: F.length(t) > 2)
    hits = lambda ts: F.size(F.filter(ts, lambda t: F.contains(v, t)))
    part = let(terms, lambda ts: (F.size(ts) > 0) & (hits(ts) * 5 >= F.size(ts) * 4))
    return F.contains(v, p) | part


def stem(token: Column) -> Column:
    """Lower case without ./:-_ at the ends, without a plural s (five letters or more), then without one of ing, ed, es."""
    bare = F.regexp_replace(F.lower(token), r"^[./:_-]+|[./:_-]+$", "")

    def cut(v: Column) -> Column:
        found = v
        for suffix in ("es", "ed", "ing"):
            found = F.when(v.endswith(suffix) & (F.length(v) > len(suffix) + 3), F.left(v, F.length(v) - len(suffix))).otherwise(found)
        return found

    return let(let(bare, lambda v: F.when(v.endswith("s") & (F.length(v) > 4), F.left(v, F.length(v) - 1)).otherwise(v)), cut)


def leakage_errors(text: Column) -> Column:
    found = [F.when(text.rlike(p), F.lit(f"public leakage: {name}")) for name, p in LEAKAGE.items()]
    return F.array_compact(F.array(*found))


def normalize_answer(text: Column) -> Column:
    """Lower case, then no ASCII punctuation, then no articles, then single spaces."""
    t = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return squeeze(F.regexp_replace(t, r"\b(a|an|the)\b", " "))


def token_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays, by runs of the sorted arrays."""
    numbered = lambda xs: let(F.array_sort(xs), lambda s: F.transform(s, lambda x, i: F.struct(x.alias("t"), (i - F.array_position(s, x)).alias("k"))))
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def f1_parts(prediction: Column, truth: Column) -> Column:
    """struct(f1, precision, recall) of normalised answers as token multisets; a closed answer (yes, no, noanswer) must be equal.

    Null or without common tokens: zeros.
    """
    closed = ["yes", "no", "noanswer"]
    result = lambda f, p, r: F.struct(f.alias("f1"), p.alias("precision"), r.alias("recall"))
    none = result(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    words = lambda t: F.array_remove(F.split(t, " "), "")

    def score(x: Column) -> Column:
        p, r = F.try_divide(x["both"], F.size(x["a"])), F.try_divide(x["both"], F.size(x["b"]))
        return F.when(x["both"] > 0, result(2.0 * x["both"] / (F.size(x["a"]) + F.size(x["b"])), p, r)).otherwise(none)

    def compare(x: Column) -> Column:
        parts = F.struct(words(x["p"]).alias("a"), words(x["t"]).alias("b"))
        both = let(parts, lambda y: F.struct(y["a"].alias("a"), y["b"].alias("b"), token_overlap(y["a"], y["b"]).alias("both")))
        apart = (x["p"] != x["t"]) & (x["p"].isin(closed) | x["t"].isin(closed))
        return F.when(apart, none).otherwise(let(both, score))

    pair = F.struct(normalize_answer(prediction).alias("p"), normalize_answer(truth).alias("t"))
    return F.coalesce(F.when(prediction.isNotNull() & truth.isNotNull(), let(pair, compare)), none)


def f1(prediction: Column, truth: Column) -> Column:
    return f1_parts(prediction, truth)["f1"]


def exact_match(prediction: Column, golds: Column) -> Column:
    return let(normalize_answer(prediction), lambda p: F.exists(golds, lambda g: normalize_answer(g) == p))


def choice_letter(response: Column, letters: Column | str = "ABCDEFGHIJ") -> Column:
    """First valid letter by three phrasings in turn, else the last valid capital that stands alone; thoughts are left out.

    Of each phrasing the first match counts, valid or not. ``letters``: the valid ones, as a text.
    """
    valid = F.lit(letters) if isinstance(letters, str) else letters

    def find(text: Column) -> Column:
        phrased = [F.upper(F.regexp_extract(text, p, 1)) for p in CHOICES]
        named = [F.when((x != "") & F.contains(valid, x), x) for x in phrased]
        alone = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z])\b"), 1), lambda c: F.contains(valid, c))
        return F.coalesce(*named, let(alone, lambda a: F.get(a, F.size(a) - 1)))

    return let(after_think(response), find)


def choice_reward(response: Column, label: Column, choices: Column, correct: Column | None = None) -> Column:
    """1 where the response picks the right choice, else 0; by letter, else by the words of the right choice.

    ``label`` is a letter or the text of a choice (``choices``: array, null where
    there are none); ``correct`` the letter if it is known. Ten letters are valid
    without choices. Null responses get 0.
    """
    fold = lambda t: F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))
    ten = F.lit("ABCDEFGHIJ")
    valid = F.coalesce(F.left(ten, F.size(choices)), ten)
    text = F.trim(label)
    given = F.lit(None).cast("string") if correct is None else F.upper(F.trim(correct))
    by_label = F.when((F.length(text) == 1) & F.contains(valid, F.upper(text)), F.upper(text))
    by_choice = F.array_position(F.transform(choices, fold), fold(text)).cast("int")
    by_choice = F.when(by_choice > 0, F.substring(valid, by_choice, F.lit(1)))

    def grade(x: Column) -> Column:
        at = F.instr(valid, x["right"])
        held = F.array_compact(F.array(F.get(choices, at - 1), F.when(text != "", text)))
        targets = F.filter(F.transform(held, fold), lambda t: t != "")
        named = F.exists(targets, lambda t: F.contains(x["said"], t))
        bare = x["letter"].isNotNull() & x["right"].isNull() & (x["letter"] == F.upper(text))
        return F.when(x["letter"].isNotNull() & x["right"].isNotNull(), (x["letter"] == x["right"]).cast("double")).otherwise(
            F.coalesce(named | bare, F.coalesce(named, F.lit(False))).cast("double"))

    state = F.struct(
        choice_letter(response, valid).alias("letter"), F.coalesce(given, by_label, by_choice).alias("right"), fold(after_think(response)).alias("said")
    )
    return F.when(response.isNull(), 0.0).otherwise(let(state, grade))


def last_answer(text: Column, tail: int = 300) -> Column:
    """What follows the last "Answer:" on its line in the last ``tail`` characters; null without one."""
    found = F.regexp_extract_all(F.right(text, F.lit(tail)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), 1)
    return F.when(F.size(found) > 0, F.trim(F.get(found, F.size(found) - 1)))


def answer_block(text: Column, least: int = 2) -> Column:
    """The last <answer> block, if there are at least ``least`` (the prompt holds one)."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), 1)
    return F.when(F.size(found) >= least, F.trim(F.get(found, F.size(found) - 1)))


def split_tuple(text: Column) -> Column:
    """Elements of a tuple or interval, commas inside numbers removed first."""
    t = F.regexp_replace(F.trim(text), r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    inner = F.regexp_extract(t, r"^[\[(](.*)[\])]$", 1)
    plain = (inner == "") | F.contains(inner, F.lit("(")) | F.contains(inner, F.lit("["))
    return F.when(plain, F.array(t)).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x)))


def truncate_middle(text: Column, limit: int, marker: str = TRUNCATED) -> Column:
    """Head and tail around a marker, ``limit`` characters together, an odd one in the tail; short texts stay.

    No limit gives the empty text, one within the marker the head alone.
    """
    if limit <= 0:
        return F.when(text.isNotNull(), "")
    room = limit - len(marker)
    head, tail = max(1, room // 2), max(1, room - room // 2)
    cut = F.left(text, F.lit(limit)) if room <= 0 else F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(tail)))
    stays = F.length(text) <= (limit if room <= 0 else max(limit, head + tail))
    return F.when(stays, text).otherwise(cut)


def truncate_halves(text: Column, limit: int, marker: str = "\n[... middle truncated ...]\n") -> Column:
    """Equal halves around a marker, with eighty characters of ``limit`` left for it; short texts stay."""
    half = F.lit(max(0, (limit - 80) // 2))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, half), F.lit(marker), F.right(text, half)))


def loop_signature(text: Column, chars: int = 400) -> Column:
    return F.md5(F.left(F.trim(text), F.lit(chars)).cast("binary"))


def collapse_counters(text: Column) -> Column:
    """Generated counters of script names become #, white space single; other numbers stay."""
    return squeeze(F.regexp_replace(text, COUNTER, "$1#"))


def safe_label(value: Column, default: str = "", longest: int = 160) -> Column:
    """Trimmed, other characters than those of labels as _, at most ``longest`` of them; null or blank: the default."""
    t = F.regexp_replace(F.regexp_replace(value, r"^\s+|\s+$", ""), LABEL, "_")
    return F.left(F.when(F.coalesce(t, F.lit("")) == "", default).otherwise(t), F.lit(longest))


def model_family(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(F.contains(n, F.lit("qwen")), "qwen").when(F.contains(n, F.lit("glm")), "glm").otherwise("other")


def payload_format(text: Column, ended: Column) -> Column:
    """not_terminal where the branch hasn't ended; else unified_diff if lines of all three kinds are there, or non_patch."""
    marks = [F.coalesce(text.rlike(p), F.lit(False)) for p in (r"(?m)^diff --git ", r"(?m)^--- ", r"(?m)^\+\+\+ ")]
    return F.when(~F.coalesce(ended, F.lit(False)), "not_terminal").when(marks[0] & marks[1] & marks[2], "unified_diff").otherwise("non_patch")


def approximate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def search_query(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "))


def numbered_passages(passages: Column) -> Column:
    """"Doc i(Title: first line) rest" of each passage, one a line."""

    def line(p: Column, i: Column) -> Column:
        title = F.substring_index(p, "\n", 1)
        rest = F.substring(p, F.length(title) + 2, F.length(p))
        return F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), title, F.lit(") "), rest, F.lit("\n"))

    return F.concat_ws("", F.transform(passages, line))


def after_think(text: Column) -> Column:
    return F.substring_index(text, "</think>", -1)


#: Kernel classes in order; a rule holds when each of its texts is part of the name, several rules may name one class.
KERNELS = [
    (["nccl"], "NCCL Communication"), (["deep_ep", "dispatch"], "DeepEP Dispatch (MoE)"), (["deep_ep", "combine"], "DeepEP Combine (MoE)"),
    (["deep_ep", "clean"], "DeepEP Buffer Clean"), (["deep_ep"], "DeepEP (other)"), (["flash", "attn"], "Flash Attention"),
    (["sparse_attn"], "Sparse Attention (MLA)"), (["paged_mqa"], "Paged MQA/MLA Logits"), (["attention"], "Attention (other)"),
    (["fmha"], "Attention (other)"), (["deep_gemm"], "DeepGEMM (FP8)"), (["sm90_fp8_gemm"], "DeepGEMM (FP8)"), (["nvjet"], "NvJet GEMM"),
    (["gemm"], "GEMM/MatMul (other)"), (["cutlass"], "GEMM/MatMul (other)"), (["matmul"], "GEMM/MatMul (other)"),
    (["cublas"], "GEMM/MatMul (other)"), (["topk"], "TopK / MoE Routing"), (["quant"], "Quantization (FP8)"), (["norm"], "Normalization"),
    (["triton"], "Fused/Triton Kernels"), (["fused"], "Fused/Triton Kernels"), (["elementwise"], "Elementwise Ops"),
    (["reduce"], "Reduce/Softmax"), (["softmax"], "Reduce/Softmax"), (["embedding"], "Embedding"), (["memcpy"], "Memory Ops"),
    (["memset"], "Memory Ops"), (["index"], "Index/Gather/Scatter"), (["scatter"], "Index/Gather/Scatter"),
    (["gather"], "Index/Gather/Scatter"), (["cat", "batched"], "Concat/Cat"),
]


def ordered_class(name: Column, rules: list[tuple[list[str], str]] = KERNELS, other: str = "Other Compute") -> Column:
    """Label of the first rule whose texts are all part of the lower-cased name."""

    def label(low: Column) -> Column:
        out = F.lit(other)
        for parts, found in reversed(rules):
            holds = [F.contains(low, F.lit(p)) for p in parts]
            out = F.when(holds[0] & holds[-1], found).otherwise(out)
        return out

    return let(F.lower(name), label)


def compression(text: Column, algorithm: str = "zlib", level: int = 9) -> Column:
    """(ratio, savings in per cent) of the UTF-8 text; empty: (inf, 0), null: null. In Arrow batches."""
    if algorithm not in _COMPRESS:
        raise ValueError(f"unknown algorithm: {algorithm}")
    pack = _COMPRESS[algorithm]

    @F.pandas_udf("ratio double, savings double")
    def run(texts: pd.Series) -> pd.DataFrame:
        before = [None if t is None else t.encode() for t in texts]
        after = [len(pack(b, level)) if b else 0 for b in before]
        ratio = [None if b is None else len(b) / n if n else float("inf") for b, n in zip(before, after, strict=True)]
        saved = [None if b is None else 100 * (1 - n / len(b)) if n else 0.0 for b, n in zip(before, after, strict=True)]
        return pd.DataFrame({"ratio": ratio, "savings": saved}, dtype="float64")

    return F.when(text.isNotNull(), run(text))
