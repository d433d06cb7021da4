"""Ids are decoded in whole arrays, as the library decodes them one text at a time."""

import time

import pyarrow as pa

from logquarry.llm import bpe


def known():
    return pa.array(bpe.pieces(bpe.default_vocabulary()), pa.large_binary())


def test_as_the_library_decodes():
    """Null, empty and sliced lists, special tokens, and ids whose bytes aren't UTF-8."""
    tokenizer = bpe.load(bpe.default_vocabulary())
    size = tokenizer.get_vocab_size()
    lists = [[1, 2], None, [], [220, 130, 131, 5], list(range(size)), tokenizer.encode("ñ über 漢字 <|endoftext|>", add_special_tokens=False).ids]
    column = pa.array(lists, pa.list_(pa.int32()))
    want = [tokenizer.decode(x or [], skip_special_tokens=False) for x in lists]
    assert bpe.joined(column, known()).to_pylist() == want
    for k in range(len(lists)):
        assert bpe.joined(column.slice(k, 2), known()).to_pylist() == want[k : k + 2]
    assert len(bpe.joined(column.slice(0, 0), known())) == 0


def test_no_python_object_for_each_id():
    """A million ids take well under the second or so that a Python object for each of them takes."""
    ids = bpe.load(bpe.default_vocabulary()).encode("the same words again " * 50, add_special_tokens=False).ids
    column, table = pa.array([ids * 10] * (1_000_000 // (10 * len(ids))), pa.list_(pa.int32())), known()
    start = time.process_time()
    texts = bpe.joined(column, table)
    assert time.process_time() - start < 0.3 and texts[0].as_py() == "the same words again " * 500
