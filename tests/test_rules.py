"""Golden tables for the column rules."""

import pytest

from listingloom.functions import contact as C
from listingloom.functions import hours as O
from listingloom.functions import text as T


def test_worker_hours(apply):
    table = {
        "Monday: 12:00 pm - 9:00 pm": "12:00 - 21:00",
        "7:30 am - 7 pm": "07:30 - 19:00",
        "9 am - 5 pm": "09:00 - 17:00",
        "12 am - 11:59 pm": "00:00 - 23:59",
        "8:00am-6:00pm": "08:00 - 18:00",
        "9:00 am - 12:00 pm, 2:00 pm - 6:00 pm": "09:00 - 12:00 & 14:00 - 18:00",
        "7 am - 12 pm and 1 pm - 8 pm": "07:00 - 12:00 & 13:00 - 20:00",
        "Open 24 hours": "Open 24 hours",
        "Closed": "Closed",
        # 24-hour times are padded by the export only
        "Montag: 9:00 - 18:00": "9:00 - 18:00",
        "12:30 pm - 12:30 am": "12:30 - 00:30",
        "13 PM": "13 pm",
        "1:2:30 pm": "1:14:30",
        "9 am to 2:5 pm": "09:00 - 14:05",
        "Dimanche : Fermé": "Closed",
        "9 am – 5 pm  ": "09:00 - 17:00",
        "9 am7 pm": "09:00 19:00",
        "99999999999 pm": "99999999999 pm",
    }
    assert apply(O.hours_of_row, list(table)) == list(table.values())


def test_export_hours(apply):
    table = {
        "9 a.m.–6 p.m.": "09:00 - 18:00",
        "9:30 A.M.–12:15 p.m.": "09:30 - 12:15",
        "12 a.m. - 12 p.m.": "00:00 - 12:00",
        "8:30 - 20:00": "08:30 - 20:00",
        "Montag: 9:00 - 18:00": "09:00 - 18:00",
        "09:00 - 12:00 & 14:00 - 18:00": "09:00 - 12:00",
        "GESCHLOSSEN": "Closed",
        "fermé": "Closed",
        "Open 24 hours": "Open 24 hours",
        "by request!": "by request",
        "Tuesday": "Tuesday",
        "": "",
        "  ": "",
    }
    assert apply(O.format_hours, list(table)) == list(table.values())
    both = apply(lambda c: O.format_hours(c, True), ["9:00 - 12:00 & 14:00 - 18:00"])
    assert both == ["09:00 - 12:00 & 14:00 - 18:00"]


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("Lunes 9-5", "Monday"), ("terça-feira", "Tuesday"), ("MERCOLEDÌ", "Wednesday"),
        ("closed sunday and monday", "Monday"), ("nothing", None),
    ],
)
def test_detect_day(apply, text, day):
    assert apply(O.detect_day, [text]) == [day]


def test_day_words_are_whole_words(apply):
    assert apply(O.translate_day_words, ["Lunedì, Montags, montag"]) == ["Monday, Montags, Monday"]


def test_phones(apply):
    cases = [
        ("044 832 81 00", "CH", "+41", "+41 44 832 81 00"),
        ("0844 843 823", "CH", "+41", "+41 84 484 38 23"),
        ("+43 664 1971080", "AT", "+43", "+436 64 197 10 80"),
        ("+41 44 832 81 00", "CH", "+41", "+414 48328100"),
        ("030 1234567", "DE", "+49", "+49 301234567"),
        ("(089) 12345678", "DE", "+49", "+49 891 2345678"),
        ("06 12 34 56 78", "FR", "+33", "+33 0612345678"),
        ("0664 197108", "AT", "+43", "+43 6641 97108"),
        ("+", "CH", "+41", "+"),
        ("+x23456789", "CH", "+41", "+x 234 56 789"),
        ("  ", "CH", "+41", ""),
    ]
    phones, countries, prefixes, expected = (list(c) for c in zip(*cases))
    assert apply(C.normalise_phone, phones, countries, prefixes) == expected
    known = apply(
        lambda *c: C.normalise_phone(*c, known_codes=True),
        ["+43 664 1971080", "+41 44 832 81 00", "+423 1234", "+1 212 5550123", "+44 2071234567"],
        ["AT"] * 5, ["+43"] * 5,
    )
    assert known == ["+43 66 419 71 080", "+41 44 832 81 00", "+423 1234", "+121 25550123", "+442 07 123 45 67"]


def test_validators(apply):
    assert apply(C.valid_name, ["Bakery", "Search Bar", "4.5", " ", "12 Monkeys"]) == [
        "Bakery", None, None, None, "12 Monkeys",
    ]
    assert apply(C.valid_rating, ["4,3", "5", "6.1", "n/a", "3.0 stars", "0", "4.50"]) == [
        "4.3", "5.0", None, None, "3.0", "0.0", "4.5",
    ]
    assert apply(
        C.valid_reviews,
        ["(1.309)", "1309 reviews", "2.451 Bewertungen", "1,204", "12 recensioni", "1.2", "(12,5)", "none"],
    ) == ["1309", "1309", "2451", "1204", None, "12", None, None]
    assert apply(
        C.valid_phone,
        ["+41 44 839", "044 123", "(044) 1", "1234567", "44 839 34", "4.5(12)", "CHF 12", "x" * 51, "Tel +41 44 8"],
    ) == ["+41 44 839", "044 123", "(044) 1", "1234567", "44 839 34", None, None, None, "Tel +41 44 8"]
    assert apply(C.valid_category, ["Bakery", "4", "5 star", "★", "v1.2"]) == ["Bakery", None, None, None, None]


def test_export_formats(apply):
    assert apply(C.format_phone, ["Bahnhofstrasse 1", " 044 ", "a, b", None]) == ["", "044", "", ""]
    assert apply(C.format_rating, ["4,2 stars", "5", " none "]) == ["4.2", "5", "none"]
    assert apply(C.format_reviews, ["(1.234)", "1,234 reviews", " x "]) == ["1.234", "1,234", "x"]
    assert apply(C.format_website, ["a.ch", "http://a", " a b.ch ", "none"]) == [
        "https://a.ch", "http://a", "a b.ch", "none",
    ]


def test_scan_phone(apply):
    texts = ["call +41 44 123 45 67 now", "044 123 45 67", "(044) 123 45 67", "nr 12", "+1 2 3 4"]
    assert apply(C.scan_phone, texts) == ["+41 44 123 45 67", "044 123 45 67", "(044) 123 45 67", "", ""]


def test_folds(apply):
    assert apply(T.fold_full, ["Müller & Söhne", "Foo!", "Åkersberga Røros ß", " a   b "]) == [
        "Muller Sohne", "Foo ", "Aakersberga Roeros ss", "a b",
    ]
    assert apply(T.fold_light, ["Åkersberga", "Æ ø ß é "]) == ["Akersberga", "AE o ss é"]
    # folding again changes nothing but a space at the end
    once = apply(T.fold_full, ["Café Zürich!", "x — y", "§§"])
    assert [x.strip() for x in apply(T.fold_full, once)] == [x.strip() for x in once]


def test_search_variations(apply):
    assert apply(T.search_variations, ["Bäckerei Müller GmbH", "Plain", "", "X", "Å AB"]) == [
        ["Bäckerei Müller GmbH", "Backerei Muller GmbH", "Bäckerei Müller", "Backerei Muller"],
        ["Plain"], [""], [], ["Å AB", "Aa AB", "A AB"],
    ]


def test_csv_cells(apply):
    assert apply(T.csv_cell_doubled, ['say "hi"', "a,\nb", " x ", None]) == ['"say """"hi"""""', '"a, b"', "x", ""]


def test_encoded_query(apply):
    assert apply(T.uri_component, ["a b!~*'()é+&"]) == ["a%20b!~*'()%C3%A9%2B%26"]


def test_numbers(apply):
    assert apply(lambda c: T.number_text(c.cast("double")), ["47.0", "46.9480", "0.0001", "-75.4794"]) == [
        "47", "46.948", "0.0001", "-75.4794",
    ]
    assert apply(lambda a, b: T.percent(a.cast("int"), b.cast("int")), ["57", "1", "0"], ["200", "8", "0"]) == [28, 13, None]
