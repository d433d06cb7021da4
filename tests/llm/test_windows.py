"""Windows reach two words past the last trigger, and decode as whole texts do."""

import random

from logquarry.llm import pii


def test_windows_reach_past_every_trigger():
    text = "call +1 (743) 555-3824 one two three four"
    spans = pii.windows_of(text, True)
    assert [[text[a:b] for a, b in window] for window in spans] == [text.split()[:6]]


def test_windows_decode_like_whole_texts():
    field, whole = pii.Field(*pii.train()), pii.Field(*pii.train())
    whole.windowed = False
    rng = random.Random(3)
    odd = ["well-known", "(aside)", "[x]", "deadbeefdeadbeefdeadbeef", "--", "a.b.c.d", "it's", "٣٤٥", "plain", "(", "_", "x/y"]
    values = ["+1 (743) 555-3824", "190.137.223.20", "4111 1111", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"', "12345", "a@b.example.org"]
    texts = [" ".join(rng.choice(odd if rng.random() < 0.8 else values) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    assert field.windowed and pii.find_spans(texts, field) == pii.find_spans(texts, whole)
