import hashlib
import random

import pytest

from trajlake.llm.bpe import ByteBPE, decode_ids, default_path, encode_texts, token_digests

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None, "", " ", "  \n\n x", "Hello world, it's 3½ o'clock don't we'll I'M", "<|endoftext|>a<|endoftext|><|endo",
    "Éau ñandú Straße ²³¼ ١٢٣ 漢字テスト 🙂👩‍👩‍👧", "a b c\x1cd\x85e　f​", "x" * 5000, " " * 4000 + "y", "ab" * 3000,
    "naïve ĀāſƀǍ ŉ ª º µ × ÷ · ´ ¨ ¯", "\t\ttabs\r\nlines\x0b\x0c", "12345 67.89%$$$ !!! |||", "\x00\x01\x7f",
]


def texts():
    rng = random.Random(3)
    pools = ["abcdeéüñ '.,\n\t 0129", "".join(map(chr, range(32, 900))), "   \n\x1c\x1d\x85aZ٣", "aaaaab "]
    more = ["".join(rng.choice(pools[i % 4]) for _ in range(rng.randrange(1, 200))) for i in range(600)]
    return TEXTS + more


def test_equals_library_and_round_trips():
    library = tokenizers.Tokenizer.from_file(default_path())
    coder = ByteBPE.from_file(default_path())
    for text in texts():
        want = library.encode(text or "", add_special_tokens=False).ids
        assert coder.encode(text or "") == want, repr(text)
        assert coder.decode(want) == library.decode(want, skip_special_tokens=False)
        some = want[1::2]
        assert coder.decode(some) == library.decode(some, skip_special_tokens=False)


def test_frames(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    library = tokenizers.Tokenizer.from_file(default_path())
    path = default_path()
    back = {r.doc_id: r for r in decode_ids(encode_texts(docs, path), path).collect()}
    digest = {r.doc_id: r for r in token_digests(docs, path).collect()}
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert back[doc].ids == ids and back[doc].decoded == (text or "") and back[doc].text == text
        assert digest[doc].n_tokens == len(ids)
        assert digest[doc].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digest[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert token_digests(docs.limit(0), path).count() == 0
