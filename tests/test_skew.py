"""One issue holding most comments: results stay exact and no step needs the
whole hot issue in one task (running sums are range-split, counts partial)."""

import random

from pyspark.sql import functions as F

from issuesift.operators import conversation as C
from issuesift.operators.metrics import add_metrics

ISSUE_T = ("repo string, number long, pos long, title string, body string, state string, author string, "
           "reactions_total long")
COMMENT_T = "repo string, number long, idx long, body string, author string, reactions_total long"


def test_hot_issue_text_and_metrics(spark):
    rng = random.Random(5)
    issues = [("r", n, n, f"t{n}", "body", "open", "u", None) for n in range(20)]
    comments = []
    for i in range(60000):               # issue 0 gets ~60k comments
        size = rng.choice([0, 1, 3, 7])
        comments.append(("r", 0, i, "x" * size if size else rng.choice(["", " ", None]), "a", i % 3))
    for n in range(1, 20):
        for i in range(rng.randint(0, 5)):
            comments.append(("r", n, i, "c" * rng.randint(0, 3000), "b", 1))
    idf = spark.createDataFrame(issues, ISSUE_T)
    cdf = spark.createDataFrame(comments, COMMENT_T).repartition(16)
    conv = {r.number: r.conversation for r in C.conversation(idf, cdf).collect()}
    emb = {r.number: r.embed_text for r in C.embedding_text(idf, cdf).collect()}
    # what is kept is the longest run of comments, in order, whose lengths stay within the budget
    for n in range(20):
        texts = [c[3] or "" for c in sorted((c for c in comments if c[1] == n), key=lambda c: c[2])]
        kept = [p[len("a: "):] for p in conv[n].split("\n\n")[2:] if not p.startswith("[...")]
        assert [p.split(" [")[0].strip() for p in kept] == [t.strip() for t in texts if t.strip()][:len(kept)]
        size, whole = sum(len(p.split(" [")[0]) for p in kept), sum(len(t) for t in texts if t.strip())
        assert conv[n].endswith("[... more comments truncated for conversation]") == (whole > 25000)
        assert size == whole if whole <= 25000 else 25000 - 7 < size <= 25000
        lines = emb[n].split("\n")
        cut = lines[-1] == "[... more comments truncated]"
        assert cut == (sum(map(len, texts)) > 8000)
        assert sum(map(len, lines[2:len(lines) - cut])) <= 8000
    m = {r.number: r for r in add_metrics(idf.withColumn("createdAt", F.current_timestamp())
                                          .withColumn("updatedAt", F.current_timestamp()), cdf).collect()}
    assert m[0].comment_count == 60000
    assert m[0].comment_emojis == sum(c[5] for c in comments if c[1] == 0)
