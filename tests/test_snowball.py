"""Stemmers against words whose stems the published descriptions and sample vocabularies give."""

import pytest

from fathom.functions.analysis import custom
from fathom.functions.snowball import STEMMERS

CASES = {
    "english": "consign:consign consigned:consign consigning:consign consignment:consign consist:consist consistency:consist consolation:consol consolatory:consolatori consolidating:consolid knack:knack knackeries:knackeri knavish:knavish kneeling:kneel knightly:knight skies:sky dying:die ugly:ugli news:news inning:inning proceed:proceed generous:generous generally:general communism:communism happy:happi say:say cry:cri by:by gas:gas this:this ties:tie hopping:hop hoping:hope luxuriated:luxuri conspicuously:conspicu running:run relational:relat dogs:dog",
    "german": "aufeinander:aufeinand aufeinanderfolge:aufeinanderfolg aufenthalt:aufenthalt aufgeblüht:aufgebluht auferstanden:auferstand kategorie:kategori kategorisch:kategor kauft:kauft kaufmann:kaufmann kaum:kaum häuser:haus verständnisses:verstandnis schönheit:schonheit",
    "french": "continu:continu continua:continu continuait:continu continuant:continu continuation:continu continuellement:continuel contradiction:contradict contradictoirement:contradictoir majestueusement:majestu majorité:major maladif:malad mangeront:mang chevaux:cheval nationalité:national",
    "spanish": "cheques:chequ chicas:chic chicharrones:chicharron torneo:torne torre:torr torres:torr tórtola:tortol trabajando:trabaj nacionalidad:nacional rápidamente:rapid canciones:cancion",
    "italian": "abbandonata:abbandon abbandonati:abbandon abbandonò:abbandon pronunciamento:pronunc propaga:propag propagarono:propag chiarezza:chiarezz",
    "portuguese": "boa:boa boas:boas boba:bob quilométricas:quilométr quilômetro:quilômetr quimera:quim química:químic nacionalidade:nacional",
    "dutch": "lichaamszorg:lichaamszorg lichamelijk:licham lichamelijke:licham lichamelijkheden:licham lichten:licht opgaven:opgav opgeheven:opgehev opglimpende:opglimp",
    "swedish": "jakten:jakt jaktkarlarne:jaktkarl jakthund:jakthund kloka:klok klokaste:klok klänningarna:klänning",
    "norwegian": "havnedistrikter:havnedistrikt havnedistriktene:havnedistrikt opning:opning opningen:opning oppbygging:oppbygging",
    "danish": "indtage:indtag indtager:indtag indtil:indtil underliggende:underlig undersøgelse:undersøg undersøgelsen:undersøg bøgerne:bøg",
    "russian": "вавиловка:вавиловк вагнера:вагнер вагон:вагон вагона:вагон вагоне:вагон важная:важн важнее:важн важнейшие:важн пошла:пошл пощадить:пощад читавший:чита",
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_stems(language):
    got = {w: STEMMERS[language](w) for w, _ in (c.split(":") for c in CASES[language].split())}
    assert got == dict(c.split(":") for c in CASES[language].split())


@pytest.mark.parametrize("name", sorted(STEMMERS))
def test_any_term(name):
    for w in ("", "a", "y", "s", "e", "ss", "en", "es", "ii", "qu", "123", "日本", "x" * 1000, "aeiou" * 50, "'s", "st", "heid", "guas", "ё", "ь"):
        assert isinstance(STEMMERS[name](w), str)


def test_names_without_a_stemmer_are_refused(spark):
    for f in ({"type": "snowballStemming", "stemmerName": "finnish"}, {"type": "snowballStemming", "stemmerName": "lovins"}, {"type": "kStemming"}, {"type": "stempel"}):
        with pytest.raises(ValueError, match="no stemmer"):
            custom({"name": "mine", "tokenizer": {"type": "whitespace"}, "tokenFilters": [f]}).analyze(spark, "running")


@pytest.mark.parametrize(
    ("language", "cases"),
    [
        ("german", "häuser:haus hauses:haus haus:haus kindern:kind schönste:schon schnellsten:schnell"),
        ("spanish", "chicas:chic chicos:chic luces:luz intereses:interes niños:niñ casa:casa canción:cancion"),
        ("italian", "ragazzo:ragazz ragazzi:ragazz amiche:amic virtù:virtù bianchi:bianc propri:propr notizia:notiz"),
        ("portuguese", "quilométricas:quilometric quilométricos:quilometric papéis:papel animais:animal homens:homem corações:coraca felizmente:feliz mulheres:mulher"),
    ],
)
def test_light_stems(language, cases):
    from fathom.functions.stemming import LIGHT

    assert {w: LIGHT[language](w) for w, _ in (c.split(":") for c in cases.split())} == dict(c.split(":") for c in cases.split())
