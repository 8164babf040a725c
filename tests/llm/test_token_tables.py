"""What a worker asks of the library one word at a time."""

import pytest

from meridia.llm import tokens


class _Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.alone = tokenizer, []

    def encode(self, text, **kind):
        self.alone.append(text)
        return self.tokenizer.encode(text, **kind)

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_first_words_of_lines_are_encoded_together(name):
    e = tokens.Encoder(tokens.public_path(name))
    for table in (e.first, e.rest):
        table.tokenizer = _Counted(e.tokenizer)
    texts = ["\n".join(f"{a}{k}, {a}b {a}{b}. x{k}Ա (b)" for k in range(50) for a, b in ("pq", "Rs", "té")), "", "one", None, "Ա" * 60 + " " + "Ա" * 60]
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [memoryview(ids).cast("I").tolist() for ids in e.encode_all(texts)] == want
    assert len({*e.first.tokenizer.alone, *e.rest.tokenizer.alone}) <= 3  # the line break and words too long to keep
