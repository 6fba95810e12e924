"""Refusals, breaks and languages in wordings that no pattern was written for."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.llm import pair_defects

REFUSALS = (
    "I'm afraid that's off the table for me.", "That isn't something I'm comfortable with.", "I'm going to have to pass on this one.", "I won't be able to get into that, sorry.",
    "My guidelines prevent me from going into this.", "I'd prefer to leave that question unanswered.", "Sorry, no can do - my hands are tied here.", "This falls outside of what I do, so I'll have to say no.",
    "I regret that I am not in a position to oblige.", "We are not permitted to comment on this topic.", "As an AI, I don't take part in such requests.", "I have been instructed to steer clear of this subject.",
    "It would not be right for me to help you with this.", "I'm not going to help with that.", "Unfortunately, this is not something we can assist with.", "Please forgive me, but I must turn this down.",
    "I choose not to engage with this topic.", "I am prohibited from discussing this matter.", "Not something I can do for you, I'm afraid.", "I do not feel comfortable providing that.",
    "I can't go along with that.", "That request crosses a line for me, so I am not answering it.", "I must respectfully say no to this.", "Sorry, but I'm not able to do that.", "I'm unwilling to provide that information.",
    "We cannot comply with your demand.", "I don't think I should answer that.", "Answering this would go against our policy.", "No, I won't tell you that.", "I'm not authorised to disclose this.",
    "Regrettably I have to refuse.", "I would prefer not to say.", "That's a subject I can't speak about.", "I am afraid I can't do that.", "I have to decline this one.", "My rules do not allow me to reply to this.",
    "It's against my principles to answer.", "I'm sorry, this is not something I will discuss.", "I refuse to answer this question.", "Apologies, but I will not be answering that.",
)
ANSWERS = (
    "The documents do not mention it.", "I could not find any entry on K-1 in the indexed files.", "The seal was not replaced, I am sorry to report; see INC-1.", "No, K-2 may not run with loose packing.",
    "It is not allowed to open the drain before the permit is signed.", "We replaced the seal and it is not leaking any more.", "I have no information on that in the documents.", "The operator refused to sign the permit.",
    "The trip may not be bypassed without a permit.", "Unfortunately the files contain nothing about the pump.", "I suggest to pass the result on to the engineer.", "The shift supervisor declined the request of the contractor.",
    "Our pump is off line and not running.", "You must not enter the vessel; I would ask the permit issuer first.", "My answer is 12 barg.", "I read 30 mm at the nozzle, not 33 mm.", "The valve must stay closed.",
    "I am not sure which pump is meant; could you name its tag?", "None of our records holds this tag.", "We do not stock this part; the supplier is Mipvostar Supply.",
)


def test_refusals_of_many_wordings(spark):
    df = spark.createDataFrame([(a, True) for a in REFUSALS] + [(a, False) for a in ANSWERS], "answer string, refuses boolean")
    got = {r["refuses"]: r for r in df.groupBy("refuses").agg(F.count("*").alias("n"), F.count_if(pair_defects.declines(F.col("answer"))).alias("found")).collect()}
    assert got[True]["found"] >= 0.9 * got[True]["n"] and got[False]["found"] == 0


def test_short_answers_that_break_off():
    for answer in ("The pump was stopped because", "Replace the seal and then", "Der Druck ist", "from order for the", "The seal,"):
        assert pair_defects.examine("What is it?", answer)[0] == "truncated"
    for answer in ("No", "the area authority", "4 weeks from order", "October 2021", "30.0 mm", "Yes."):
        assert pair_defects.examine("What is it?", answer)[0] is None


def test_answers_in_languages_beyond_the_four():
    for answer in ("Le joint fuit encore.", "La guarnizione è stata sostituita durante la fermata.", "A bomba não está a funcionar porque a vedação foi danificada.", "De pomp is gestopt omdat de afdichting lekt.", "Насос остановлен из-за вибрации."):
        assert pair_defects.examine("What was found at the pump when it was opened?", answer)[0] == "other_language"
    assert pair_defects.examine("Answer in Italian: what was found at the pump?", "La guarnizione è stata sostituita durante la fermata.")[0] is None


def test_word_cut_short_in_a_short_answer(spark):
    rows = [(i, "Who signs?", "The maintenance planner signs it.") for i in range(3)] + [(9, "Who signs?", "the maint"), (10, "Who signs?", "the maintenance planner")]
    df = spark.createDataFrame(rows, "rec_id long, prompt string, answer string")
    assert [(r["rec_id"], r["defect"]) for r in pair_defects.defective_pairs(df).collect()] == [(9, "truncated")]
