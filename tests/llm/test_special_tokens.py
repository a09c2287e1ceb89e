"""Ids of texts that hold a special token, as the plain call of the library gives them."""

import public_tokenizers
from tokenizers import Tokenizer

from weftline.llm import dac

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_special_tokens_in_texts():
    end = "<|endoftext|>"
    texts = [f"one {end} two", end, f"{end}{end} a", f"a{end}b c", f"a  {end}  b", f" {end}\n {end} ", f"x\n{end} y {end}z é{end}", "one <|endof text|> two", f"a \n{end}\n\n b"]
    library = Tokenizer.from_file(BPE)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [505, 220, 50256, 734]
    got = dac.Encoder(BPE).encode(texts)
    assert [[int.from_bytes(g[k : k + 4], "little") for k in range(0, len(g), 4)] for g in got] == want
