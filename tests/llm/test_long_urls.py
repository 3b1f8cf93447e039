"""Rules on tokens that stand late in a URL."""

from ebbmark.llm import urlrules


def test_rules_of_long_urls(spark):
    front = [f"a{i:02d}" for i in range(30)]  # always together: as many combinations as subsets, if mined singly
    rows = [(["host:x", "zz"], "block")] * 40 + [([*front, "zz"], "allow")] * 30 + [([*front, "zy"], "block")] * 10 + [([*front, "zx"], "allow")] * 20
    data = spark.createDataFrame([(sorted(x), v) for x, v in rows], "items array<string>, verdict string")
    got = {(tuple(r["items"]), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in
           urlrules.mine(data, urlrules.Settings(support=0.05, confidence=0.9)).collect()}
    want = {(("zy",), "block"): (1.0, 0.1), (("host:x",), "block"): (1.0, 0.4), (("zx",), "allow"): (1.0, 0.2)}
    want |= {((a, "zz"), "allow"): (1.0, 0.3) for a in front}
    assert got == want  # neither zz alone (30 of 70 are allow) nor a token of the front (50 of 60) decides
