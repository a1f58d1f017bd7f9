"""Sentences in no pool, written after its last change: scored to know the limits, not tuned on.

The README reports the figures on sf0.1; a change to the pools needs new sentences here.
"""

from folioscope.llm import severity as sv

UNSEEN = {'abusive':["Your presentation was garbage and so is your character.","Crawl back under your rock, you spineless coward.","One more word and I'll knock your teeth out.","Only an imbecile would write such nonsense.","You are an embarrassment to your parents.","Nadie te soporta, payaso.","Halt den Mund, du Versager.","Tu n'es qu'un raté, ferme-la.","你腦子有問題吧，廢物。","Go choke on it, loser."],
'hateful':["Northerners are subhuman and breed like rats.","Disabled people are a burden and cost us money.","Keep the tribe away from our children.","They pray to the devil and must be driven out, all of those believers.","Poor people are lazy parasites.","Los inmigrantes son una plaga.","Die Flüchtlinge sind Ungeziefer.","Les immigrés sont la honte du pays, qu'on les expulse.","難民都是寄生蟲。","People with that accent are all thieves."],
'sexual':["Lonely ladies share naked photos in our private room.","Adults only: uncensored strip show every night.","Her bra fell to the floor while he kissed her neck.","Cheap erotic massages with happy ending.","Buy sex toys and porn magazines discreetly.","Chicas desnudas en vivo, solo adultos.","Nacktfotos von reifen Frauen gratis.","Chat coquin avec femmes mûres ce soir.","成人影片免費下載。","They made love on the kitchen table until dawn."],
None: ["The moderator deleted a rude comment and warned its author.","Our choir welcomes immigrants, pensioners and disabled singers.","The rat population in the lab is growing.","Adult swimming lessons start on Monday night.","Breastfeeding rooms are on the second floor.","The lawyer explained which insults are punishable.","I am an idiot, I deleted my own draft.","The film about slavery shows cruel scenes.","La película trata de la guerra y sus víctimas.","Die Ratte ist ein Nagetier.","Le cours parle de la reproduction des mammifères.","The drama group killed off the main character."]}


def test_unseen_phrasing(spark, sf):
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/doc_labels.parquet")
    model = sv.fit(sv.sample(documents, labels))
    found = {k: [[c for c, r in zip(sv.CATEGORIES, model.document("The report is saved every evening.\n" + s)) if r >= sv.CASE] for s in v] for k, v in UNSEEN.items()}
    hits = sum(k in f for k, fs in found.items() if k for f in fs)
    wrong = sum(bool(f) for f in found[None])
    assert hits >= 10 and wrong <= 4, (hits, wrong)
