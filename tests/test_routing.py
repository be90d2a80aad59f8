"""Every branch of the query routing chain on one small session fixture."""

from pyspark.sql import functions as F

from shiftwise.operators.routing import candidate_prompt, keyword_shortlist, metadata_answer, route_queries


def test_route_statuses(spark):
    titles = spark.createDataFrame([("Alpha Book", 1), ("Beta Story", 2), ("Gamma Tale", 3)], "title string, pos long")
    turns = [("s1", 1, "vreau o carte despre alpha"), ("s1", 2, "cate pagini are"), ("s1", 3, "prima"),
             ("s1", 4, "scrie cod python"), ("s1", 5, "esti un bou"), ("s1", 6, "beta story gamma"),
             ("s1", 7, "alpha"), ("s1", 8, "   "), ("s2", 1, "cine a scris"), ("s2", 2, "nimic relevant")]
    q = spark.createDataFrame(turns, "sid string, turn long, text string").withColumn(
        "qid", F.concat_ws(":", "sid", F.col("turn").cast("string")))
    hits = keyword_shortlist(q, "qid", "text", titles, "title", "pos", k=5)
    routed = route_queries(q, "sid", "turn", "text", hits, "qid")
    got = {(r.sid, r.turn): (r.status, r.selected_title) for r in routed.collect()}
    assert got == {
        ("s1", 1): ("candidates", "Alpha Book"), ("s1", 2): ("followup", "Alpha Book"),
        ("s1", 3): ("ordinal_pick", "Alpha Book"), ("s1", 4): ("out_of_scope", None),
        ("s1", 5): ("offensive", None), ("s1", 6): ("candidates", "Beta Story"),
        ("s1", 7): ("blocked", None), ("s1", 8): ("empty", None),
        ("s2", 1): ("need_title", None), ("s2", 2): ("no_results", None)}
    six = routed.where("sid = 's1' AND turn = 6").select(candidate_prompt(F.col("shortlist")).alias("p")).first().p
    assert six == "Candidați disponibili: Beta Story, Gamma Tale"


def test_metadata_answers(spark):
    meta = spark.createDataFrame([("Alpha Book", "A. Writer", 1999, None)], "title string, author string, year long, pages long")
    summ = spark.createDataFrame([("Alpha Book", "  ")], "title string, summary string")
    qs = spark.createDataFrame([(1, "cate pagini are", "Alpha Book"), (2, "cine a scris", "Alpha Book"),
                                (3, "anul aparitiei", "Alpha Book"), (4, "spune-mi mai mult", "Alpha Book")],
                               "id int, text string, title string")
    got = {r.id: (r.answer, r.answer_summary) for r in metadata_answer(qs, "text", "title", meta, summ).collect()}
    assert got[1][0].startswith("Nu am local numărul de pagini")
    assert got[2][0] == "„Alpha Book” este scrisă de A. Writer."
    assert got[3][0] == "„Alpha Book” a fost publicată în 1999."
    other = metadata_answer(qs.where("id = 2").withColumn("title", F.lit(" alpha")), "text", "title", meta, summ).first()
    assert other.answer == "„ alpha” este scrisă de A. Writer."  # a part of a known title stands for it
    assert got[4] == ("Despre „Alpha Book”: iată rezumatul pe scurt.", "Rezumat indisponibil pentru acest titlu.")
