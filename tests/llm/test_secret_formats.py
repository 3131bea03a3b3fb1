"""What op2_secrets learns and scores, against plain Python."""

import math
import random
import re
from collections import Counter

from themeloom.llm import secret_scan

TEXTS = ["plain words, a1 of v1.2.3 and x_y=z é12345é\n", None, "", "0123456789-ABCDEF. end", "é abc abcd"]


def test_background_is_of_all_documents(spark):
    texts = TEXTS + [f"only lower case words {'of' * (i % 5)}" for i in range(2_500)] + ["ZZZZ9999" * 50]
    model = secret_scan.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    seen = Counter()
    for t in texts:
        for w in re.findall(r"[A-Za-z0-9+/_.=-]{4,}", t or ""):
            s = "^" + w.translate(secret_scan._TO_CLASS) + "$"
            seen.update(zip(s, s[1:]))
    for a in "^" + secret_scan.CLASSES:
        total = sum(n for (x, _), n in seen.items() if x == a) + len(secret_scan.CLASSES) + 1
        want = {b: math.log((seen[a, b] + 1) / total) for b in secret_scan.CLASSES + "$"}
        assert model.bigrams[a] == want


def test_short_dotted_and_partly_covered_credentials_are_found(spark):
    rng = random.Random(3)

    def some(of, n):
        return "".join(rng.choice(of) for _ in range(n))

    def short():
        return some("GHKXZ", 2) + some("0123456789", 8)

    def dotted():
        return f"{some('0123456789', 6)}.{some('0123456789', 6)}.{some('GHKXZ', 8)}"

    prose = "The quick words of ordinary prose, at 10.30 on 2024-05-06, see chapter-2 or item_7 of NATO.org. "
    texts = [prose + f"token = '{short()}' and secret: {dotted()} end" for _ in range(300)] + [prose * 3] * 20
    a, b, c, hexes = short(), dotted(), short(), "0af1" * 6
    texts += [f"{prose}{a} there", f"{prose}{b}. Then", f"{prose}{hexes}{c} there", "plain " + "0af1" * 6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = secret_scan.fit(docs)
    for text, value in ((texts[320], a), (texts[321], b), (texts[322], c)):
        found = [s for s in model.spans(text, secret_scan.base_spans(text)) if s[2] == "grammar"]
        assert [(text[s:e], v) for s, e, _, v in found] == [(value, value)]
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, model).collect()}
    assert a not in clean[320] and b not in clean[321] and c not in clean[322] and hexes not in clean[322]
    assert clean[323] == "plain [secret]"
    assert all(clean[i] == texts[i] for i in range(300, 320))


def test_uncovered():
    assert secret_scan.uncovered(5, 20, []) == [(5, 20)]
    assert secret_scan.uncovered(5, 20, [(0, 7, "", ""), (6, 8, "", ""), (10, 12, "", ""), (11, 11, "", ""), (18, 30, "", "")]) == [(8, 10), (12, 18)]
    assert secret_scan.uncovered(5, 20, [(0, 30, "", "")]) == []
