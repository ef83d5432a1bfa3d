"""Prompt texts and worked examples.

The wording is this library's own; callers may pass templates of their own.  Templates use
``{source}``, ``{text}``, ``{guide}``, ``{count}`` and ``{examples}``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM = {
    "mcq": (
        "You write multiple choice questions that a reader can answer without the source.\n"
        "Name every person, place, work and date. Never point at a text, passage or author.\n"
        "Give exactly four options of one kind and similar length, without letter labels.\n\n"
        "{examples}"
    ),
    "open": (
        "You write open study questions. Reply with JSON only.\n"
        "Each question carries all the context it needs and names what it asks about."
    ),
    "flashcard": "You make short flashcards for study.",
    "training": (
        "You write multiple choice questions for a training set.\n"
        "Questions stand alone and name people, places, events and dates.\n"
        "There are four different, believable options of one kind."
    ),
    "summary": "You condense book passages and reply with JSON only.",
    "classify": "You label book passages and reply with JSON only.",
}
USER = {
    "mcq": (
        "{guide}\n\nWrite one question on the content below.\n\nSource: \"{source}\"\nContent:\n{text}\n\n"
        'Reply as {"question": "", "options": ["", "", "", ""], "correctIndex": 0, "explanation": ""}'
    ),
    "open": (
        "{guide}\n\nWrite one open question with its ideal answer on the content below.\n\n"
        "Source: \"{source}\"\nContent:\n{text}\n\n"
        'Reply as {"question": "", "idealAnswer": "", "keyPoints": [""]}'
    ),
    "flashcard": (
        "Write {count} flashcards on the content below.\n\nContent:\n{text}\n\n"
        'Reply as [{"question": "", "answer": ""}]'
    ),
    "training": (
        "{guide}\n\nWrite one question that stands alone.\n\nSource: \"{source}\"\nContent:\n{text}\n\n"
        'Reply as {"question": "", "options": ["", "", "", ""], "correctIndex": 0, "explanation": ""}'
    ),
    "summary": (
        "Name the kind of this passage (content, toc, index, copyright, bibliography). If it is content, "
        "retell it in two or three full paragraphs and keep names, dates and arguments.\n\nPassage:\n{text}\n\n"
        'Reply as {"type": "content", "summary": "", "chapter": null, "section": null}'
    ),
    "classify": (
        "Label this passage as content, toc, frontMatter, citation or index and rate its worth for study "
        "from 0 to 1.\n\nPassage:\n{text}\n\n"
        'Reply as {"type": "content", "chapter": null, "section": null, "quality": 0.5}'
    ),
}
#: Longest passage put into a prompt, in characters.
PASSAGE_CHARS = {"mcq": 800, "open": 800, "flashcard": None, "training": 800, "summary": 1500, "classify": 500}
GUIDES = {
    "easy": "Level easy: ask for one stated fact such as a date, name, place or definition.",
    "medium": "Level medium: ask why or how, so that the answer links two ideas.",
    "hard": "Level hard: ask for an implication, contrast or synthesis beyond the wording.",
}
ANSWER_SYSTEM = (
    "You answer questions from the context given. Where it is silent, say so and add what is "
    "generally known. Be short and exact."
)
ANSWER_CONTEXT = "Answer from this context:\n\n{context}\n\n---"
MCQ_TUTOR = (
    "You tutor a student who has just answered a quiz question.\n\nQuestion: {question}\n"
    "Student's answer: {given} ({verdict})\nCorrect answer: {correct}\nExplanation: {explanation}\n"
    "Source: {source}\n\nBe brief and kind; explain why the correct answer holds."
)
OPEN_TUTOR = (
    "You are a study partner who asks rather than tells.\n\nMaterial:\n{context}\n\n"
    "Topic: {question}\nKey points: {points}"
)
DISTRACTOR_RULES = (
    "WRONG OPTIONS SHOULD: share the kind and length of the right one, be close in time or topic, "
    "and tempt a careless reader.\nWRONG OPTIONS SHOULD NOT: be absurd, off topic, jokes or "
    "rewordings of the right one."
)

#: (difficulty, text, question, options, correct index, explanation)
GOLD_EXAMPLES = [
    ("easy", "The Erie Canal opened in 1825 and joined the Hudson River to Lake Erie.",
     "In which year did the Erie Canal open?", ["1825", "1803", "1848", "1869"], 0,
     "The Erie Canal opened in 1825."),
    ("easy", "Mercury is the planet closest to the Sun and has no moons.",
     "Which planet of the Solar System is closest to the Sun?",
     ["Venus", "Mercury", "Mars", "Earth"], 1, "Mercury orbits nearest to the Sun."),
    ("easy", "Ada Lovelace published notes on Charles Babbage's Analytical Engine in 1843.",
     "Who published notes on Charles Babbage's Analytical Engine in 1843?",
     ["Mary Somerville", "Grace Hopper", "Ada Lovelace", "Sofia Kovalevskaya"], 2,
     "Ada Lovelace wrote the notes of 1843."),
    ("easy", "The Limpopo River flows through southern Africa into the Indian Ocean.",
     "Into which ocean does the Limpopo River flow?",
     ["Atlantic Ocean", "Arctic Ocean", "Southern Ocean", "Indian Ocean"], 3,
     "The Limpopo River reaches the Indian Ocean."),
    ("medium", "Because copper conducts well and resists corrosion, Victorian engineers chose it for sea cables.",
     "Why did Victorian engineers choose copper for undersea telegraph cables?",
     ["It conducts well and resists corrosion", "It floats in salt water",
      "It was the cheapest metal of the time", "It needs no insulation at all"], 0,
     "Good conduction and resistance to corrosion made copper suitable."),
    ("medium", "Crop rotation with clover returned nitrogen to Norfolk fields, so no year had to lie fallow.",
     "How did clover make fallow years needless in the Norfolk crop rotation?",
     ["It shaded out all weeds", "It returned nitrogen to the soil",
      "It drained wet meadows", "It fed draught horses in winter"], 1,
     "Clover restores nitrogen, which keeps the soil fertile."),
    ("medium", "Printing lowered the price of books in Venice, which widened the circle of readers.",
     "How did printing change the readership of books in fifteenth-century Venice?",
     ["It limited books to clergy", "It moved reading to universities",
      "It widened the circle of readers", "It replaced public speech"], 2,
     "Cheaper books reached more readers."),
    ("medium", "Coral bleaches when warm water makes it expel the algae that feed it.",
     "Why does warm sea water cause coral to bleach?",
     ["It dissolves the coral skeleton", "It attracts grazing fish",
      "It blocks sunlight from reefs", "It makes coral expel its algae"], 3,
     "Without its algae coral loses food and colour."),
    ("hard", "Jevons noted that better steam engines raised the use of coal, since cheap power found new uses.",
     "What paradox about efficiency did William Stanley Jevons find in the use of coal?",
     ["Better engines raised total coal use", "Better engines ended coal imports",
      "Worse engines saved more coal", "Coal prices ignored engine design"], 0,
     "Savings per task were outweighed by the growth of tasks."),
    ("hard", "A census counts people where they sleep, so commuter towns look larger than the work done in them.",
     "What does counting people where they sleep imply for a census of commuter towns?",
     ["It undercounts their residents", "It overstates the work done in them",
      "It ignores all children there", "It doubles the count of offices"], 1,
     "Residents are counted at home while their work happens elsewhere."),
    ("hard", "Ostrom showed that villages can govern shared pastures without owners or state, given clear local rules.",
     "Which assumption about shared pastures does the work of Elinor Ostrom question?",
     ["That pastures need yearly rest", "That villages keep written rules",
      "That only owners or the state can prevent overuse", "That herds grow without limit"], 2,
     "Local rules can do what was thought to need ownership or the state."),
    ("hard", "Galileo's inclined planes slowed falling bodies enough to time them with water clocks.",
     "What does Galileo's use of inclined planes suggest about the limits of his instruments?",
     ["They could not weigh bodies", "They measured only heat",
      "They required perfect vacuum", "They were too slow to time free fall"], 3,
     "Slower motion was needed because water clocks could not time free fall."),
    ("easy", "The Rosetta Stone was found in Egypt in 1799 and carries one decree in three scripts.",
     "In which year was the Rosetta Stone found in Egypt?", ["1815", "1799", "1822", "1750"], 1,
     "The stone was found in 1799."),
    ("easy", "Iron melts at about 1538 degrees Celsius under normal pressure.",
     "At about what temperature in degrees Celsius does iron melt?",
     ["961", "660", "1538", "3422"], 2, "Iron melts at about 1538 degrees Celsius."),
    ("easy", "Wangari Maathai founded the Green Belt Movement in Kenya in 1977.",
     "Who founded the Green Belt Movement in Kenya in 1977?",
     ["Ellen Johnson Sirleaf", "Miriam Makeba", "Graça Machel", "Wangari Maathai"], 3,
     "Wangari Maathai founded the movement."),
    ("easy", "The capital of Mongolia, Ulaanbaatar, lies on the Tuul River.",
     "On which river does the Mongolian capital Ulaanbaatar lie?",
     ["Tuul", "Selenga", "Onon", "Kherlen"], 0, "Ulaanbaatar lies on the Tuul."),
    ("easy", "A sonnet has fourteen lines, commonly in iambic pentameter in English.",
     "How many lines does a sonnet have?", ["Twelve", "Fourteen", "Sixteen", "Ten"], 1,
     "A sonnet has fourteen lines."),
    ("easy", "Igneous rock forms when molten rock cools and hardens.",
     "Which kind of rock forms when molten rock cools?",
     ["Sedimentary", "Metamorphic", "Igneous", "Organic"], 2, "Cooling melt gives igneous rock."),
    ("medium", "Because Venice had little land, its merchants put their wealth into ships and glass rather than fields.",
     "Why did Venetian merchants invest in ships and glass rather than fields?",
     ["Venice had little land", "Law forbade farming", "Glass paid all taxes", "Ships needed no crews"], 0,
     "Scarce land turned capital to trade and craft."),
    ("medium", "A vaccine shows the immune system a harmless part of a germ, so memory cells stand ready for the real one.",
     "How does a vaccine prepare the body for a later infection?",
     ["It kills germs in the blood", "It leaves memory cells for the germ",
      "It thickens the skin barrier", "It lowers body temperature"], 1,
     "Memory cells formed by the harmless part respond faster."),
    ("medium", "Standard gauges let wagons of different lines run through, which cut the cost of reloading freight.",
     "How did a standard track gauge lower the cost of rail freight?",
     ["It needed less coal", "It made trains shorter", "It spared the reloading of wagons", "It raised ticket prices"], 2,
     "Through wagons made reloading at line borders needless."),
    ("medium", "Owls hunt by night with uneven ear openings, which let them place a sound in height as well as direction.",
     "Why do uneven ear openings help owls to hunt in the dark?",
     ["They block the wind", "They warm the head", "They hide the ears", "They place sounds in height"], 3,
     "The difference between the ears tells how high a sound lies."),
    ("medium", "Terraces on steep Andean slopes slowed runoff, so soil and water stayed where maize could use them.",
     "How did Andean terraces make steep slopes fit for maize?",
     ["They slowed runoff and kept soil", "They melted mountain ice",
      "They shaded young plants", "They drew water from wells"], 0, "Slower runoff keeps soil and water in place."),
    ("medium", "Inflation outran wages in the German cities of 1923, so workers asked to be paid daily.",
     "Why did workers in German cities ask for daily pay in 1923?",
     ["Banks had closed for good", "Money lost value within days",
      "Factories moved abroad", "Taxes fell due each night"], 1, "Pay lost its value if it was held."),
    ("hard", "Semmelweis lowered deaths by hand washing before germs were known, yet colleagues rejected a rule without a theory.",
     "What does the rejection of Ignaz Semmelweis suggest about how medicine accepted evidence?",
     ["Results alone were not enough without a theory", "Statistics were seen as final",
      "Hand washing was thought costly", "Hospitals lacked written records"], 0,
     "His numbers were clear, but no accepted theory explained them."),
    ("hard", "When Britain paid for dead cobras in Delhi, people bred them; ending the bounty set them free.",
     "Which general risk of incentives does the Delhi cobra bounty illustrate?",
     ["Rewards are always too small", "A measure can be met while its aim is defeated",
      "Animals cannot be counted", "Cities need no rules"], 1, "The payment rewarded breeding, not fewer snakes."),
    ("hard", "Borges imagined a map as large as the land it shows, and so of no use.",
     "What does the full-size map imagined by Jorge Luis Borges imply about models?",
     ["Models must be secret", "Models age faster than land",
      "A model is useful because it leaves things out", "Larger models cost less"], 2,
     "Without omission a map gains nothing over the land."),
    ("hard", "Darwin's finches differ in beaks by island, though one ancestor had reached the archipelago.",
     "What does the variety of beaks among Galápagos finches imply about their common ancestor?",
     ["It had several beaks", "It came from every island",
      "It never left the coast", "Its descendants adapted to different foods"], 3,
     "Different foods on the islands favoured different beaks."),
    ("hard", "Arrow proved that no ranked voting rule can meet a short list of fair demands at once.",
     "What does the theorem of Kenneth Arrow imply for the search for a perfect voting rule?",
     ["Some fair demand must be given up", "Only majority rule is fair",
      "Voters should not rank candidates", "Small groups vote at random"], 0,
     "The demands cannot all hold together."),
    ("hard", "Concrete used by Roman builders hardened further in sea water, while modern concrete decays there.",
     "Which assumption about material progress does Roman marine concrete question?",
     ["That all stone is alike", "That newer materials last longer in every use",
      "That lime needs no water", "That harbours need timber"], 1,
     "An older recipe outlasts a newer one in the sea."),
]


def render(template: str, **values: Column | str) -> Column:
    """Fill ``{name}`` places of a template; other braces stay as they are."""
    names = "|".join(values)
    parts = re.split(r"\{(" + names + r")\}", template) if names else [template]
    cols = [
        (values[p] if isinstance(values[p], Column) else F.lit(values[p])) if i % 2 else F.lit(p)
        for i, p in enumerate(parts)
    ]
    return F.concat(*cols)
