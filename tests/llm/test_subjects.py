import random

from marginalia.llm import subjects

NAMES = ["sport", "law", "machine_learning"]
TERMS = {
    "sport": ["referee", "striker", "medal", "stadium", "penalty kick"],
    "law": ["verdict", "tribunal", "affidavit", "plaintiff", "penalty clause"],
    "machine_learning": ["gradient", "embedding", "classifier", "dropout", "kernel"],
}
FILLER = ["No threshold was changed.", "Further details can be requested.", "Ties were broken by position."]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        about = rng.sample(NAMES, rng.choice([0, 1, 1, 2]))
        units = [f"The {rng.choice(TERMS[s])} of Sys{i % 120} was measured." for s in about for _ in range(rng.randint(2, 4))]
        units += rng.choices(FILLER, k=3)
        rest = [s for s in NAMES if s not in about]
        if rest and rng.random() < 0.4:
            units.append(f"As an aside, this recalls a {TERMS[rng.choice(rest)][0]}.")
        rng.shuffle(units)
        docs.append((i, " ".join(units), f"66{i % 120:02d}.1", 0))
        truth[i] = set(about)
    return docs, truth


def run(spark, docs, labels, names=NAMES, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, paper_id string, units int")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, term long")
    got = {}
    for r in subjects.document_subjects(d, lab, names, **options).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    return got


def test_held_out_accuracy(spark):
    docs, truth = corpus()
    rng = random.Random(2)
    labels = []
    for i in range(0, 400, 3):
        said = truth[i] if rng.random() > 0.05 else {rng.choice(NAMES)}
        labels += [(i, {0: s, 1: f" {s.upper()}", 2: s.replace("_", " ")}[rng.randrange(3)], 0) for s in said] or [(i, None, 0)]
    got = run(spark, docs, labels + labels[:10] + [(1, "unheard of", 0)])
    held = [i for i in truth if i % 3]
    hit = sum(len(got.get(i, set()) & truth[i]) for i in held)
    said, real = sum(len(got.get(i, set())) for i in held), sum(len(truth[i]) for i in held)
    assert hit / said > 0.95 and hit / real > 0.9


def test_units():
    text = "One is here. Two is there! [3] A line\nitem | a | b\nunder var-\nying load"
    assert len(subjects.text_units(text)) == 5
    terms = lambda t: [x.tolist() for x in subjects.text_terms(t)]
    assert terms("Kernеls") == terms("kernel") and terms("12 3") == terms("") == [[], []]
    unit, term = terms("one two. one")
    assert unit == [0, 0, 1, 0] and term[0] == term[2] != term[3]
    assert subjects.text_units("") == []


def test_edges(spark):
    docs, truth = corpus(90)
    labels = [(i, s, 0) for i in truth for s in truth[i]]
    odd = [(1000, None, None, 0), (1001, "", "p", 0), (1002, "-", "p", 0), (1003, "x" * 100_000, None, 0), (1004, docs[0][1], None, 0)]
    got = run(spark, docs + odd, labels)
    assert not {1000, 1001, 1002, 1003} & set(got)
    assert got.get(1004, set()) == got.get(0, set())
    assert run(spark, [], labels) == {} and run(spark, docs, []) == {} and run(spark, docs, labels, names=[]) == {}


def test_shares(spark):
    d = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "doc_id long")
    found = spark.createDataFrame([(1, "sport"), (1, "law"), (2, "law")], "doc_id long, subject string")
    got = {r.subject: (r.documents, round(r.share, 6)) for r in subjects.subject_shares(d, found, NAMES).collect()}
    assert got == {"sport": (1, 0.166667), "law": (2, 0.5), "machine_learning": (0, 0.0), "none": (1, 0.333333)}


def test_papers_are_counted_exactly(spark):
    at = {}
    for i in range(500):  # papers whose hashes share their low six bits
        at.setdefault(subjects.xxhash.xxh64_intdigest(f"{6000 + i}.1") & 63, []).append(f"{6000 + i}.1")
    three = max(at.values(), key=len)[:3]
    docs = spark.createDataFrame([(str(i), "The zymurgy was measured.", p) for i, p in enumerate(three)], "node string, text string, paper string")
    tokens = subjects.tokenised(docs).withColumn("t", subjects.F.col("node").cast("long"))
    known = spark.createDataFrame([(i, 1.0) for i in range(3)], "t long, s0 double")
    assert subjects.learn(tokens, known, 1, 1.0, 3, 3).count() > 0
    assert subjects.learn(tokens.withColumn("paper", subjects.F.lit(three[0])), known, 1, 1.0, 3, 2).count() == 0


def test_a_step_equals_one_over_listed_pairs(spark):
    """A term carries to a document the mean label of all its neighbours through that term, itself included."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["verdict", "medal", "kernel", "audit", "orbit"]) for _ in range(3)) for _ in range(25)]
    docs = spark.createDataFrame([(str(i), t, str(i)) for i, t in enumerate(texts)], "node string, text string, paper string")
    tokens = subjects.tokenised(docs).withColumn("t", subjects.F.col("node").cast("long"))
    y = {i: float(rng.random() < 0.5) for i in range(0, 25, 2)}
    known = spark.createDataFrame(list(y.items()), "t long, s0 double")
    got = {r.term: r.s0 for r in subjects.learn(tokens, known, 1, 0.0, 1, 1).collect()}
    held = {i: set(subjects.text_terms(t)[1].tolist()) for i, t in enumerate(texts)}
    for i in range(25):
        for term in held[i]:
            linked = [j for j in y if term in held[j]]  # the pairs (i, j) that share the term
            assert (term in got) == bool(linked)
            assert not linked or abs(got[term] - sum(y[j] for j in linked) / len(linked)) < 1e-12


def test_trusted_seeds_stay(spark):
    docs, truth = corpus(120)
    labels = [(i, s, 0) for i in truth for s in truth[i] if i % 2]
    docs += [(500, "Nothing that anyone knows of.", "9.1", 0), (501, "Nothing that anyone knows of.", "9.2", 0)]
    wrong = 502
    docs += [(wrong, "The tribunal of Sys1 was measured. The affidavit of Sys1 was measured. The plaintiff of Sys1 was measured.", "9.3", 0)]
    got = run(spark, docs, labels + [(500, "sport", 0), (wrong, "sport", 0)])
    assert got[500] == got[501] == {"sport"}  # nothing speaks against it, and equal texts are one node
    assert got[wrong] == {"law"}  # contradicted by its text
    assert all(truth[i] <= got[i] for i in truth if i % 2 and truth[i])
