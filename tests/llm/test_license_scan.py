import random
import re
from math import ceil

import pytest

from trellisq.llm import license_scan as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    base = [(i, label) for phrase, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    met, start = [], 0
    for line in lower.split("\n"):
        held = WORD.findall(line)
        for at in range(0, max(1, len(held) - 32), 32):
            block = set(held[at : at + 64])
            for label, template in L.TEMPLATES.items():
                wanted = set(WORD.findall(template))
                if len(template.split()) <= 32 and len(wanted & block) >= ceil(L.THRESHOLD * len(wanted) - 1e-9):
                    met.append((label, start + at, len(wanted & block) / len(wanted)))
        start += len(held)
    spots = [i for i, _ in base]
    labels = {x for _, x in base}
    score = 1.0 if base else max((c for *_, c in met), default=0.0)
    return len(words), len(base), min(spots, default=None), max(spots, default=None), sorted(labels), sorted(labels | {x for x, *_ in met}), score, sorted(met)


TEXTS = [
    None, "", "\n\n", "CC-BY cc by cc by CC, BY", "All rights reserved. all rights, reserved", "General Public License", "éCC BY cc byé cc\xa0by",
    "Licensed under the Apache License, Version 2.0.", "Licensed under Apache License, Version 2.0", "released under MIT", "Released under the MIT License.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "filler " * 200 + "Licensed under CC BY-NC 4.0. " + "filler " * 200, "word " * 20000,
]


def test_scan_equals_brute_force(spark):
    pick = random.Random(3)
    words = sorted({w for t in [*L.TEMPLATES.values(), *L.PHRASES] for w in t.split()}) + ["x", "y"]
    texts = TEXTS + [" ".join(pick.choice(words) + pick.choice(["", "", ".", "\n"]) for _ in range(pick.randint(1, 150))) for _ in range(200)]
    for template in L.TEMPLATES.values():
        kept = template.split()
        texts += ["\n".join(["a b", " ".join(w for w in kept if pick.random() > 0.1), "c"]) for _ in range(10)]
    frame = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string").repartition(3)
    got = {r["doc_id"]: (*r[1:8], sorted((b["label"], b["start"], b["containment"]) for b in r["blocks"])) for r in L.scan(frame).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert sum(bool(x[7]) for x in got.values()) > 20
    assert L.scan(frame.limit(0)).count() == 0


def test_templates_of_any_length():
    with pytest.raises(ValueError):
        L.Index({"x": ""}, {})
    words = [f"w{i}".encode() for i in range(400)]
    index = L.Index({"x": " ".join(w.decode() for w in words)}, {})
    filler = [b"f"] * 90
    assert [x[0] for x in index.spans(filler + words[:200] + filler + words[200:350] + filler)] == ["x"]
    assert not list(index.spans(filler + words[:330] + filler))


def test_statements_that_are_wrapped_or_lie_across_windows(spark):
    pick = random.Random(5)
    vocabulary = sorted({w for t in L.TEMPLATES.values() for w in t.split()}) + ["x", "y", "z"] * 40
    texts = [("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:")]
    for label, template in L.TEMPLATES.items():
        kept = template.split()
        half = len(kept) // 2
        for lead in (0, 7, 20, 31):
            texts.append((label, "a\n" * lead + " ".join(kept[:half]) + "\n" + " ".join(kept[half:]) + "\nb"))
            # One line; the words lie over more than half a window.
            texts.append((label, "f " * (lead + 40) + " ".join(kept[:half]) + " g" * (L.window_of(template) - 2 - len(kept)) + " " + " ".join(kept[half:]) + " f" * 90))
            # Hard-wrapped, a few words changed.
            changed = [w for i, w in enumerate(kept) if (i + lead) % 25 != 3]
            texts.append((label if len(kept) > 60 else None, "\n * ".join(" ".join(changed[i : i + 9]) for i in range(0, len(changed), 9))))
    texts += [(None, " ".join(pick.choice(vocabulary) + pick.choice(["", "\n"]) for _ in range(pick.randint(1, 300)))) for _ in range(200)]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in L.scan(frame).collect():
        label, text = texts[r["doc_id"]]
        assert label is None or label in r["all_labels"], text
        words = WORD.findall(text.lower())
        best = {}
        for name, template in L.TEMPLATES.items():
            wanted = set(template.split())
            common = max((len(wanted & set(words[at : at + L.window_of(template)])) for at in range(len(words))), default=0)
            if common >= ceil(L.THRESHOLD * len(wanted) - 1e-9):
                best[name] = common / len(wanted)
        got = {}
        for x in r["spans"]:
            got[x["label"]] = max(x["containment"], got.get(x["label"], 0))
        assert got == best
        assert r["all_labels"] == sorted(best.keys() | set(r["labels"]))
