import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import tokenizing as tk

TOKENIZER = tk.load(tk.default_path())
OTHER = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))  # the same vocabulary in another library
OTHER.encode_special_tokens = True
ALPHABET = "ab'srevlmd  \n\t12é!…٪ا‌ن漢🚀<|endoftext|>"


def whole(text):
    return OTHER.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=150), st.integers(1, 30))
def test_tree_equals_whole(text, leaf):
    assert list(tk.ids_of(tk.encode(text, TOKENIZER, leaf), TOKENIZER)) == whole(text)


def test_join_is_associative():
    random.seed(4)
    for _ in range(200):
        texts = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 25))) for _ in range(3)]
        a, b, c = (tk.leaf_piece(t, TOKENIZER) for t in texts)
        left, right = tk.join(tk.join(a, b, TOKENIZER), c, TOKENIZER), tk.join(a, tk.join(b, c, TOKENIZER), TOKENIZER)
        assert list(tk.ids_of(left, TOKENIZER)) == list(tk.ids_of(right, TOKENIZER)) == whole("".join(texts))


def test_long_blanks():
    for text in ("a" + "\n" * 30_000 + "b c", " " * 20_000 + "\t", "x" + " \r\n" * 9000 + "y" + " " * 12_000):
        assert list(tk.ids_of(tk.encode(text, TOKENIZER), TOKENIZER)) == whole(text)
    assert len(tk.encode_text("\n" * 1_000_000 + "end", TOKENIZER)) > 1


def test_all_documents(spark):
    """Every document, with leaves so small that most take many levels, and parts that several tasks encode."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    given = {r.doc_id: r.text or "" for r in documents.collect()}
    assert sum(len(t) > 4 * 128 for t in given.values()) > 500
    for part, leaf in ((1 << 16, 128), (600, 100)):
        assert {r.doc_id: r.ids for r in tk.encode_ids(documents, part=part, leaf=leaf).collect()} == {k: whole(t) for k, t in given.items()}


def test_documents(spark):
    texts = {1: "plain text", 2: None, 3: "", 4: " ", 5: "x" * 5000, 6: "don't stop " * 900, 7: "a\n\n" * 2000, 8: "<|endoftext|>", 9: " " * 3000 + "end", 10: "漢🚀é" * 1500}
    df = spark.createDataFrame(list(texts.items()) + [(6, texts[6])], "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as row", "3 as node")
    for part in (1 << 16, 1000):
        got = [(r.doc_id, r.ids) for r in tk.encode_ids(df, part=part, leaf=300).collect()]
        assert sorted(got) == sorted([(k, whole(t) if t else []) for k, t in texts.items()] + [(6, whole(texts[6]))])
    assert tk.encode_ids(df.limit(0)).count() == 0
    assert tk.encode_ids(df).schema["ids"].dataType.simpleString() == "array<int>"
    back = tk.round_trip(df.where("doc_id <> 6"))
    assert back.count() == 9 and back.where("not same").count() == 0
