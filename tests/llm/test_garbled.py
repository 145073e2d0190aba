import pytest
from conftest import clash

from chunkwise.llm import garbled as gb

GERMAN = "Die Prüfsumme ergänzt den Änderungsstand für jede Größe über Nacht."
RUSSIAN = "Проверка делит подпись после сбоя, каждый сервер хранит отчёт ещё раз."
POLISH = "Usługa dołącza gałąź poniżej progu, później próba określa wiadomość."
JAPANESE = "再起動の後に検索結果を削除する。必要に応じて要約を並べ替える。"
SIGNS = "the “cluster” flag costs €92 – a café’s naïve ranking…"


@pytest.fixture(scope="module")
def finder():
    return gb.finder()


def fixed(finder, text):
    out, at = [], 0
    for a, b, new in finder.garbled(text):
        out += [text[at:a], text[a:b] if new is None else new]
        at = b
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1251"])
@pytest.mark.parametrize("text", [GERMAN, SIGNS, POLISH])
def test_round_trip_of_utf8(finder, text, wrong):
    bad = gb.wrongly(text.encode(), wrong)
    assert fixed(finder, bad) == text
    mixed = f"Right: déjà vu, Привет. {bad} Ende: schön."
    assert fixed(finder, mixed) == f"Right: déjà vu, Привет. {text} Ende: schön."


def test_twice_garbled(finder):
    assert fixed(finder, gb.wrongly(gb.wrongly(GERMAN.encode(), "cp1252").encode(), "cp1252")) == GERMAN


@pytest.mark.parametrize("pair", [("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("koi8-r", "latin-1")])
def test_round_trip_of_single_byte_cyrillic(finder, pair):
    assert fixed(finder, gb.wrongly(RUSSIAN.encode(pair[0]), pair[1])) == RUSSIAN


def test_round_trip_of_others(finder):
    assert fixed(finder, gb.wrongly(POLISH.encode("iso8859-2"), "latin-1")) == POLISH
    assert fixed(finder, gb.wrongly(RUSSIAN.encode(), "cp1252")) == RUSSIAN
    assert fixed(finder, gb.wrongly(JAPANESE.encode(), "cp1252")) == JAPANESE
    assert finder.garbled(gb.wrongly(JAPANESE.encode("cp932"), "cp1252"))


SCRIPTS = {
    "greek": "Η αναζήτηση επιστρέφει τα αποτελέσματα κάθε μέρα.",
    "ukrainian": "Перевірка ділить підпис після збою, її є ґанок.",
    "vietnamese": "Tiếng Việt có dấu thanh và nhiều nguyên âm.",
    "hebrew": "השירות מחזיר את התוצאות בכל יום מחדש",
    "arabic": "الخدمة تعيد النتائج كل يوم من جديد",
    "hindi": "यह सेवा हर दिन परिणाम लौटाती है",
    "thai": "บริการนี้ส่งคืนผลลัพธ์ทุกวัน",
    "tamil": "இந்த சேவை முடிவுகளை வழங்குகிறது",
    "georgian": "სერვისი აბრუნებს შედეგებს",
    "korean": "이 서비스는 매일 결과를 반환합니다",
    "chinese": "这个服务每天返回结果给用户，我们的系统在这里",
    "emoji": "Great job 🎉🚀 team 👍",
    "turkish": "İstanbul'da çağrı şüpheli görünüyor",
    "czech": "Příliš žluťoučký kůň úpěl ďábelské ódy.",
}


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437"])
@pytest.mark.parametrize("name", SCRIPTS)
def test_round_trip_of_any_script(finder, name, wrong):
    text = SCRIPTS[name]
    assert finder.garbled(text) == []
    assert fixed(finder, gb.wrongly(text.encode(), wrong)) == text


@pytest.mark.parametrize("true, wrong, name", [("gbk", "latin-1", "chinese"), ("gbk", "cp1252", "chinese"), ("cp1255", "cp1252", "hebrew"), ("cp1256", "cp1252", "arabic")])
def test_round_trip_of_other_encodings(finder, true, wrong, name):
    assert fixed(finder, gb.wrongly(SCRIPTS[name].encode(true), wrong)) == SCRIPTS[name]


def test_other_encodings_are_found(finder):
    for true, wrong, text in [("euc-kr", "latin-1", SCRIPTS["korean"]), ("cp1253", "cp1252", SCRIPTS["greek"]), ("euc-jp", "latin-1", JAPANESE), ("big5", "latin-1", "這個系統在這裡每天返回結果給我們的用戶")]:
        assert finder.garbled(gb.wrongly(text.encode(true), wrong)), true
    assert fixed(finder, SCRIPTS["chinese"].encode().decode("gbk")) == SCRIPTS["chinese"]
    assert fixed(finder, gb.wrongly("für Größe schön".encode("cp1252"), "mac_roman")) == "für Größe schön"


@pytest.mark.parametrize(
    "text",
    ["20 cm³ of water and 30 dm³", "x¹ y³ + z²", "m³s and m²·K, 5 µm² of 3 m²", "Miller¹ and Smith³ wrote", "naïve café", "£100 ±5 ¼cup 3½", "E=mc² a²b³c", "/ˈtɹænz.fɚ/ ˈʃoʊ", "það þetta Ísland æðri", "pаypal аccount", "β-carotene IFNγ TGFβ1",
     "┌──┬──┐\n│a │b │\n├──┼──┤\n└──┴──┘", "╔══╦══╗", "░▒▓█", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏ", "àáâãäåæçèéêëìíîï", "°±²³´µ¶·¸¹º»¼½¾¿", "«Β» «ΑΒ» τ»", "Год 2020 № 5 «Б» ска", "T恤 K歌 A型B", "œuvre cœur", "5′ 3″ ≈ 4 √2 ∂x", "پیچ گچ ژاپن"],
)
def test_signs_of_right_text_stay(finder, text):
    assert finder.garbled(text) == []


def test_lost_characters_are_found_but_left(finder):
    bad = GERMAN.encode("latin-1").decode("utf-8", "replace")
    assert finder.garbled(bad) and fixed(finder, bad) == bad


@pytest.mark.parametrize(
    "text",
    [GERMAN, RUSSIAN, POLISH, JAPANESE, SIGNS, "", "ascii", "The page shows `Ã¼` in place of ü.", "wrong output “├╝”, right output ü", "show <code>â€œ</code>?", "Reject 'Ã§' rows", "SÃO PAULO, CONFIGURAÇÃO, NÃO", "Ã Â Ê Õ Ç.", "Ångström, 5 µm × 2 °C",
     "Ÿ and Ž close the list", "ÂGE MOYEN ET PÂTURAGE", "Её ещё. Ёлка", "&Atilde;&frac14; \\u00c3", "naïve 3½ m² ¿qué? ¡sí!", "العربية हिन्दी 👩‍🔬", "ВНИМАНИЕ: ОСТАНОВКА СЕРВЕРА", "│ a │ b │\n├──┼──┤"],
)
def test_right_text_stays(finder, text):
    assert finder.garbled(text) == []


def test_rows(spark):
    bad = gb.wrongly(GERMAN.encode(), "cp1252")
    rows = [(1, bad), (1, bad), (2, GERMAN), (3, None), (4, ""), (None, bad), (5, "x" * 400000 + bad)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"), "restored", "n_spans")
    assert sorted(r["doc_id"] for r in gb.found(df).collect()) == [1, 5]
    got = [r for r in gb.restore(df).collect() if r["doc_id"] == 1]
    assert len(got) == 2 and got[0]["restored"] == GERMAN and got[0]["n_lost"] == 0
    assert gb.restore(df.where("false")).count() == 0
