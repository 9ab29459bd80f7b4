"""Plain seed sentences for the abuse classifier, and names of groups of people.

Fixed values: everyday examples of abuse, threats, hate and sexual talk, and of
sober sentences about the same matters.  They give training a first direction;
what the documents' own wording looks like has to come from the ratings.
"""

ABUSIVE = [
    "You are an idiot.", "Shut your mouth, you moron.", "You stupid bitch.", "Fuck off, asshole.", "What a worthless bastard you are.", "I will kill you.", "I am going to hurt you and your children.",
    "Kill yourself.", "I wish you were dead.", "These people are subhuman and must be wiped out.", "They are parasites, get rid of them all.", "Women are stupid and should shut up.", "Gays are perverts.",
    "Foreigners are criminals.", "Show me your naked body.", "He fucked her all night.", "She sucked his cock.", "Watch free porn with horny girls.", "I want to have sex with you right now.", "You filthy whore.",
    "Du bist ein Idiot.", "Halt dein Maul, du Trottel.", "Du dumme Schlampe.", "Verpiss dich, Arschloch.", "Ich bringe dich um.", "Bring dich doch um.", "Diese Leute sind Untermenschen.", "Ausländer sind Verbrecher.",
    "Frauen sind dumm.", "Zeig mir deine Brüste.", "Er fickte sie die ganze Nacht.", "Gratis Pornos mit geilen Weibern.", "Du bist eine widerliche Sau.",
    "Tu es un idiot.", "Ta gueule, imbécile.", "Espèce de salope.", "Va te faire foutre, connard.", "Je vais te tuer.", "Suicide-toi.", "Ces gens sont des sous-hommes.", "Les étrangers sont des criminels.",
    "Les femmes sont idiotes.", "Montre-moi tes seins.", "Il l'a baisée toute la nuit.", "Du porno gratuit avec des filles chaudes.", "Tu es une sale merde.",
    "お前はバカだ。", "黙れ、クズ。", "このアホ野郎。", "死ね。", "殺すぞ。", "自殺しろ。", "あいつらは人間以下だ、皆殺しにしろ。", "外国人は犯罪者だ。", "女はバカだ。", "お前の裸を見せろ。", "彼は一晩中彼女を犯した。", "無料のエロ動画とポルノ。", "気持ち悪いブス、消えろ。", "役立たずのゴミめ。",
]

SOBER = [
    "The policy forbids insults and threats.", "A course on hate speech is held in March.", "The nurse explained the examination.", "The dead battery was replaced.", "Women and men have the same rights.", "The office for foreigners is on the first floor.",
    "The victim reported the assault to the police.", "Sexual education is part of the programme.", "This machine is annoying and far too slow.", "The filter kills bacteria.",
    "Die Richtlinie verbietet Beleidigungen und Drohungen.", "Ein Kurs über Hassrede findet im März statt.", "Frauen und Männer haben gleiche Rechte.", "Die Ausländerbehörde ist im ersten Stock.", "Der Filter tötet Bakterien ab.", "Dieses Gerät ist lästig und viel zu langsam.",
    "Le règlement interdit les insultes et les menaces.", "Un cours sur les discours de haine a lieu en mars.", "Les femmes et les hommes ont les mêmes droits.", "Le bureau des étrangers est au premier étage.", "Le filtre tue les bactéries.", "Cette machine est agaçante et bien trop lente.",
    "規程は侮辱や脅迫を禁じる。", "ヘイトスピーチに関する講習を三月に開く。", "女性も男性も同じ権利を持つ。", "外国人相談の窓口は一階にある。", "フィルターは細菌を殺す。", "この機械は遅くて困る。", "性教育の資料を配る。", "自殺予防の電話相談を知らせる。",
]

GROUPS = {
    "en": ["women", "men", "gays", "immigrants", "foreigners", "jews", "muslims", "christians", "black people", "asians", "disabled people", "old people", "secretaries", "refugees", "germans", "japanese people"],
    "de": ["frauen", "männer", "schwule", "ausländer", "juden", "muslime", "christen", "schwarze", "behinderte", "alte leute", "flüchtlinge", "franzosen"],
    "fr": ["les femmes", "les hommes", "les homosexuels", "les étrangers", "les juifs", "les musulmans", "les chrétiens", "les noirs", "les handicapés", "les vieux", "les réfugiés", "les allemands"],
    "ja": ["女性", "男性", "女", "男", "外国人", "障害者", "老人", "同性愛者", "移民", "難民", "黒人", "中国人", "韓国人", "日本人", "ユダヤ人", "イスラム教徒", "某人", "某族"],
}
