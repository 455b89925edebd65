"""Occurrences against a search at every position."""

import random

from keepwell.llm.wu_manber import decontaminate, length_classes, merged, search_text, word_slices, words_of


def slow(text, items, window):
    words, hit, owners = words_of(text or ""), set(), set()
    for item, content in items:
        w = words_of(content or "")
        m = min(window, len(w))
        for at in range(len(w) - m + 1 if m else 0):
            for i in range(len(words) - m + 1):
                if words[i:i + m] == w[at:at + m]:
                    hit |= set(range(i, i + m))
                    owners.add(item)
    return len(words), hit, owners


def test_search_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        letters = "ab"[: rng.randint(1, 2)] + "c" * rng.randint(0, 1)
        draw = lambda n: " ".join(rng.choice(letters) for _ in range(n))
        items = [(str(i), draw(rng.randint(0, 9))) for i in range(rng.randint(0, 5))]
        text, window = draw(rng.randint(0, 40)), rng.randint(1, 6)
        n, hit, owners = slow(text, items, window)
        got = search_text(text, length_classes(items, window))
        assert got[0] == n and {p for a, b in got[1] for p in range(a, b)} == hit and got[2] == owners
        assert got[1] == merged(got[1])


def test_long_texts_are_read_in_slices(monkeypatch):
    import keepwell.llm.wu_manber as module

    text = "ab,c Éd e1 " * 50
    assert [w for part in word_slices(text, 7) for w in part] == words_of(text)
    monkeypatch.setattr(module, "word_slices", lambda t: word_slices(t, 7))
    items = [("1", "c éd e1 ab"), ("2", "c Éd e1 ab c"), ("3", "e1"), ("4", "zz e1 ab")]
    n, hit, owners = slow(text, items, 4)
    got = search_text(text, length_classes(items, 4))
    assert got[0] == n and {p for a, b in got[1] for p in range(a, b)} == hit and got[2] == owners


def test_operator_in_parts_and_odd_rows(spark):
    texts = ["One two three four five", "", None, "x", "one TWO three", "one two three four five six seven eight", "x" * 200_000]
    docs = spark.createDataFrame([(i, t, "n", i, "f", "p") for i, t in enumerate(texts)] + [(0, texts[0], "n", 0, "f", "p")],
                                 "doc_id long, text string, items string, n_words int, found string, __part0 string")
    items = [(1, "two three four"), (2, "seven Eight"), (None, "x"), (4, ""), (5, None), (6, "three four five six seven")]
    bench = spark.createDataFrame(items, "item_id long, body string")
    items += [(None, "two three four")]  # shares its window with a named item
    bench = spark.createDataFrame(items, "item_id long, body string")
    expected = {}
    for i, t in enumerate(texts):  # an item without identifier hits words, but cannot be listed
        n, hit, owners = slow(t, [(str(k), b) for k, b in items if b], 3)
        expected[i] = n, hit, owners - {"None"}
    for part_bytes in (1 << 20, 30, 1):
        got = decontaminate(docs, bench, "item_id", "body", window=3, part_bytes=part_bytes)
        python = got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
        assert python == (1 if part_bytes == 1 << 20 else 0)  # further parts are jobs of their own
        rows = got.collect()
        assert len(rows) == 8 and all(r.found == "f" and r["__part0"] == "p" for r in rows) and got.columns.count("items") == 1
        for r in rows:
            n, hit, owners = expected[r.doc_id]
            assert (r.n_words, r.n_hit, set(r["items"])) == (n, len(hit), owners)
    assert decontaminate(docs, bench.limit(0), "item_id", "body").where("n_hit > 0").count() == 0
    assert decontaminate(docs.limit(0), bench, "item_id", "body").count() == 0


def test_wide_windows_over_slices_of_one_or_two_words(monkeypatch):
    import keepwell.llm.wu_manber as module

    text = " ".join(f"w{i}" for i in range(40))
    items = [(str(i), " ".join(f"w{k}" for k in range(i, i + 10))) for i in (0, 1, 3, 7, 29)]
    classes = length_classes(items, 10)
    for size in (1, 2, 4, 15, 20, 24):
        monkeypatch.setattr(module, "word_slices", lambda t: word_slices(t, size))
        got = search_text(text, classes)
        assert got == (40, [(0, 17), (29, 39)], {"0", "1", "3", "7", "29"})
