import public_tokenizers
import pytest

from trajlake.functions.chat_templates import CHATML, Template, coder, mask_of, template_masks

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
CHAT = [
    {"role": "system", "content": "Be brief."},
    {"role": "user", "content": "What is 2+2? é日本"},
    {"role": "assistant", "content": "<think>\nadd</think>It is four.\nÉ"},
    {"role": "tool", "content": "ok <|im_sta"},
    {"role": "assistant", "content": "Done.", "train": 0},
    {"role": "assistant", "content": "<|endoftext|> as text"},
]


def parts(family, messages=CHAT, template=CHATML):
    ids, mask = mask_of(messages, family, PATH, template)
    assert len(ids) == len(mask)
    tokens = coder(PATH, tuple(template.markers))
    return tokens.decode([i for i, m in zip(ids, mask) if m], skip_special_tokens=False), tokens.decode(ids, skip_special_tokens=False)


def test_families():
    whole = "".join(CHATML.text(m["role"], m["content"]) for m in CHAT)
    assert "<|im_start|>user\n<tool_response>\nok <|im_sta\n</tool_response><|im_end|>\n" in whole
    first, last = "<think>\nadd</think>It is four.\nÉ<|im_end|>\n", "<|endoftext|> as text<|im_end|>\n"
    assert parts("spliced") == ("<|im_start|>assistant\n" + first + "<|im_start|>assistant\n" + last, whole)
    assert parts("headed") == (first + last, whole)
    assert parts("rendered") == (first.removeprefix("<think>\n") + last, whole)
    assert parts("last_answer") == ("<|endoftext|> as text", "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>assistant\n<|endoftext|> as text")
    start = coder(PATH, ("<|im_start|>", "<|im_end|>")).token_to_id("<|im_start|>")
    assert mask_of(CHAT, "rendered", PATH)[0].count(start) == len(CHAT)


def test_tokens_that_touch_a_span():
    # "\n" of the opening and what follows may be one token: it is trained as soon as one character is.
    chat = [{"role": "assistant", "content": "\n\nx"}]
    ids, mask = mask_of(chat, "rendered", PATH)
    coded = coder(PATH, ("<|im_start|>", "<|im_end|>")).encode(CHATML.text("assistant", "\n\nx"), add_special_tokens=False)
    begin = len(CHATML.opening("assistant"))
    assert ids == coded.ids and mask == [int(b > begin and b > a) for a, b in coded.offsets] and 0 < sum(mask) < len(mask)


def test_recorded_ids_and_errors():
    tokens = coder(PATH, ("<|im_start|>", "<|im_end|>"))
    end = tokens.token_to_id("<|im_end|>")
    for ids in ([7, 8, 9], [7, 8, 9, end]):
        got, mask = mask_of([{"role": "user", "content": "q"}, {"role": "assistant", "content": "ignored", "ids": ids}], "spliced", PATH)
        head = tokens.encode("<|im_start|>assistant\n", add_special_tokens=False).ids
        line = tokens.encode("\n", add_special_tokens=False).ids
        assert got[-len(head) - 4 - len(line) :] == [*head, 7, 8, 9, end, *line] and sum(mask) == len(head) + 4 + len(line)
    for bad in ([{"role": "user"}, {"role": "system"}], [{"role": "judge"}]):
        with pytest.raises(ValueError):
            mask_of(bad, "headed", PATH)
    with pytest.raises(ValueError):
        mask_of(CHAT, "unknown", PATH)


def test_default_system_and_frames(spark):
    own = Template(default_system="You help.")
    assert parts("headed", CHAT[1:2], own) == ("", "<|im_start|>system\nYou help.<|im_end|>\n" + CHATML.text("user", CHAT[1]["content"]))
    assert parts("last_answer", CHAT[1:3], own)[1].startswith("<|im_start|>system\nYou help.<|im_end|>\n<|im_start|>user")
    rows = [(1, [(m["role"], m["content"], m.get("train")) for m in CHAT], "a"), (2, [], "b"), (3, None, None), (4, [("user", None, None)], "c")]
    chats = spark.createDataFrame(rows, "k long, messages array<struct<role:string,content:string,train:int>>, `x.y` string")
    for family in ("spliced", "headed", "rendered", "last_answer"):
        got = {r.k: r for r in template_masks(chats, family, PATH).collect()}
        ids, mask = mask_of(CHAT, family, PATH)
        assert got[1].tokens == ids and got[1].loss_mask == mask and got[1].response_length == len(mask) - mask.index(1) and got[1]["x.y"] == "a"
        assert got[4].response_length == 0 and sum(got[4].loss_mask) == 0 and len(got[2].tokens) == len(got[3].tokens)
