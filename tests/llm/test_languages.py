from casegrain.llm import languages


def test_romanised_as_typed():
    assert languages.romanised("हमारी ज़मीन पर") == "hamaaree jameen par"
    assert languages.romanised("हमारी ज़मीन पर", False) == "hamari jamin par"
    assert languages.romanised("என்ன செய்ய முடியும்") == "enna seyya mudiyum"
    assert languages.romanised("abc 12") == "abc 12"


def test_margins_decide_within_a_script():
    c = languages.Compressors({
        "hi": "उसने मुझे अपनी किताब दी थी और कहा कि वह कल आएगा ".encode() * 20, "mr": "त्याने मला पुस्तक दिले होते आणि तो उद्या येणार आहे ".encode() * 20,
        "en": b" she gave me the book and said that he would come tomorrow " * 20, "ta": "அவன் நாளை வருவான் என்று சொன்னான் ".encode() * 20,
    })
    assert c.classify("उसने मुझे किताब दी थी और कहा कि वह कल आएगा")[::2] == ("hi", True)
    assert c.classify("त्याने मला पुस्तक दिले आणि तो उद्या येणार आहे")[::2] == ("mr", True)
    lang, confidence, accepted = c.classify("வேறு ஒன்றும் இல்லை")
    assert (lang, accepted) == ("ta", True) and 0.5 <= confidence <= 1
    assert c.classify("क ख ग")[2] is False and c.classify("12 ...") == (None, 0.0, False)
    # What is remembered of a text holds for its script only.
    assert c.classify("உசன் abc", "LATIN")[0] == "en" and c.classify("உசன் abc", "TAMIL")[0] == "ta"


def test_unlabelled_texts_teach_their_register(spark):
    content = {"en": b" the court held that the appeal must be allowed with costs " * 30, "ta_r": b" avar veedu nilam thaan enru sonnaar avanga enna " * 30}
    asked = [("avanga enna sonnaanga, veedu enna aachu",)] * 2 + [("the court allowed the appeal with costs",), (None,), ("",)]
    learnt = languages.learn(content, spark.createDataFrame(asked, "q string"), "q")
    assert b"aachu" in learnt["ta_r"] and b"aachu" not in learnt["en"]
    assert languages.learn(content, spark.createDataFrame([], "q string"), "q") == content


def test_a_question_with_many_numbers_does_not_crowd_out_others(spark):
    """However many texts differ in their numbers or in the order of sentences, each sentence is learnt, and once."""
    content = {"en": b" the court held that the appeal must be allowed with costs " * 30, "ta_r": b" avar veedu nilam thaan enru sonnaar avanga enna rupai vandhu " * 30}
    asked = [(f"{i} rupai vandhu nilam sonnaar. {i + 7} avanga enna sonnaar veedu",) for i in range(600)] + [("avanga enna sonnaanga, veedu enna aachu",)]
    learnt = languages.learn(content, spark.createDataFrame(asked, "q string"), "q", sample_texts=20)
    assert b"aachu" in learnt["ta_r"] and learnt["ta_r"][len(content["ta_r"]) :].count(b"rupai") == 1
    assert learnt["en"] == content["en"]
