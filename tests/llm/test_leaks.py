import random

from tieout.llm import leaks as module
from tieout.llm.leaks import leaks, words

ITEM = (
    "One missing pay assignment shows 447.46 dollars against $137.74 after the cutoff. An audit note of Katherine Stenmack arrived late at year end while the suspended audit note is missing from our second page scan. "
    "Between $5,514.37 and $9.08, this later leave payout of Iris Ilvorbrook narrows that credit. From there, on 22 September the census was read from the scan, since every setting was posted under one hourly taxable wage."
)
OTHER = "Their blank filing status depends on the provisional carrier invoice between the two cheques. On 26 May every unread filing status looked plausible, although our earlier payroll run is tied to every unmatched worksheet. A reported census column moved before the rerun of the file."


def rough(text, rng):
    out = []
    for w in text.split():
        x = rng.random()
        if x < 0.06 and len(w) > 4:
            i = rng.randrange(1, len(w) - 1)
            w = w[:i] + w[i + 1 :]
        if x > 0.95:
            out.append("really")
        out.append(w)
    return " ".join(out)


def run(spark, docs, items=((1, ITEM), (2, OTHER), (3, None), (4, "short"))):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("*", "'x' as item_id")
    e = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in leaks(d, e).collect()}


def test_leaks(spark):
    rng = random.Random(4)
    own = ITEM.split()
    half, third = " ".join(own[: int(len(own) * 0.5)]), " ".join(own[: int(len(own) * 0.28)])
    noise = "Nobody reads the minutes of the parish council, but they are kept. "
    docs = [
        ITEM, noise + rough(ITEM, rng).upper().replace(" ", "\n"), noise + half + noise, noise + third + noise, "<p>" + "</p><p>".join(half.split(". ")) + "</p>", " ".join(reversed(own)),
        noise * 50, None, "", noise + " ".join(own[:20]) + " " + noise * 3 + " ".join(own[40:62]) + noise, ITEM + "\n" + OTHER, ITEM,
    ]
    got = set(run(spark, docs))
    assert got == {(0, 1), (1, 1), (2, 1), (4, 1), (9, 1), (10, 1), (10, 2), (11, 1)}


def test_slots(spark):
    changed = ITEM.replace("447.46", "12.00").replace("137.74", "3.50").replace("Katherine Stenmack", "Petra Zolquist").replace("Iris Ilvorbrook", "Noel Kesby")
    got = run(spark, [ITEM, changed])
    assert got[0, 1].same_slots == got[0, 1].slots and got[1, 1].same_slots < got[1, 1].slots


    assert got[1, 1].clashing_slots == 0 < got[1, 1].changed_slots <= got[1, 1].slots - got[1, 1].same_slots


def test_slots_must_agree(spark):
    """One template with every name and number changed: with one new value for each it leaks, with new values at every
    place, so that one value faces several, it doesn't, as fewer than three fifths of its words stand there."""
    item = " ".join(f"Marvane Quist paid 4417 Oskbrook {verb} 4417 Marvane Quist {noun} Oskbrook." for verb, noun in (("against", "again"), ("before", "below"), ("after", "above"), ("within", "nearby"), ("without", "later")))
    item += " paid against again before below after above within nearby without later"
    new = item.replace("Marvane Quist", "Zelwin Tarb").replace("4417", "9032").replace("Oskbrook", "Fenmere")
    rng = random.Random(1)
    mixed = " ".join("".join(rng.choice("bcdfgklmnprst") for _ in range(6)).title() if w[0].isupper() else f"{rng.randrange(1000, 9999)}" if w[0].isdigit() else w for w in item.split())
    got = run(spark, [item, new, mixed], items=[(1, item)])
    assert set(got) >= {(0, 1), (1, 1)} and got[1, 1].changed_slots > 0 == got[1, 1].clashing_slots
    assert (2, 1) not in got


def test_short_items(spark):
    """Items of five words and more are found as they stand."""
    own = "quarterly premium totals rarely match printed carrier invoices before every audit closes again".split()
    items = [(n, " ".join(own[:n])) for n in range(5, 13)]
    docs = [f"Nobody reads {text} but they are kept." for _, text in items]
    got = set(run(spark, docs, items=items))
    assert {(i, n) for i, (n, _) in enumerate(items)} <= got
    assert not set(run(spark, ["nothing of the kind stands here at all, nor anywhere else", "premium totals"], items=items))


def test_blocks_and_passes_find_the_same(spark, monkeypatch):
    docs = [ITEM, OTHER, ITEM + " " + OTHER]
    want = set(run(spark, docs))
    monkeypatch.setattr(module, "ITEMS", 1)
    assert set(run(spark, docs)) == want
    monkeypatch.setattr(module, "ITEM_CHARS", 0)
    assert set(run(spark, docs)) == want == {(0, 1), (1, 2), (2, 1), (2, 2)}


def test_nothing_to_search(spark):
    assert run(spark, [ITEM], items=[(3, None)]) == {} and run(spark, [None, ""]) == {}


def test_words():
    assert words("<b>Pre-tax</b> &amp; enrol-\nment\\n1,234.50 É—x") == ["pre", "tax", "enrolment", "1", "234", "50", "e", "x"]
