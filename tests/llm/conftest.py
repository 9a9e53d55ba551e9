import os
import random
import re

import pytest

TOKENIZERS = os.environ.get("TOKENIZER_FILES", "/opt/tokenizers")


@pytest.fixture
def tokenizer_json():
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer files")
    with open(path, encoding="utf-8") as file:
        return file.read()


@pytest.fixture
def piece_file():
    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    if not os.path.exists(path):
        pytest.skip("no tokenizer files")
    return path


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def texts(seed=5, n=120):
    """Documents with copies, near copies, shared lines, one long text, nulls and empty ones."""
    r = random.Random(seed)
    names = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    out = []
    for _ in range(n):
        lines = [" ".join(r.choice(names) for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 6))]
        out.append("\n".join(lines))
    base = out[3] + "\n" + out[4] + "\n" + out[5]
    for k in range(40):  # near copies of one text
        words = base.split(" ")
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(names)
        out.append(" ".join(words))
    out += [out[0]] * 3 + [out[1].upper(), "", None, "   ", "one", "one two three four", "One TWO three four", " ".join(names * 40), "\n\n", "é ü　x\n" + out[2]]
    return out
