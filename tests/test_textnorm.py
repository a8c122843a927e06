import random

import pytest

from skein.functions import metrics, numbers, textnorm

# golden cases of number reading
GOLDEN = {
    "two": "2", "thirty one": "31", "five twenty four": "524", "nineteen ninety nine": "1999", "twenty nineteen": "2019", "two point five million": "2500000",
    "four point two billions": "4200000000s", "200 thousand": "200000", "200 thousand dollars": "$200000", "$20 million": "$20000000", "€52.4 million": "€52400000", "£77 thousands": "£77000s",
    "two double o eight": "2008", "three thousand twenty nine": "3029", "forty three thousand two hundred sixty": "43260", "forty three thousand two hundred and sixty": "43260", "nineteen fifties": "1950s",
    "thirty first": "31st", "thirty three thousand and three hundred and thirty third": "33333rd", "three billion": "3000000000", "millions": "1000000s", "july third twenty twenty": "july 3rd 2020",
    "august twenty sixth twenty twenty one": "august 26th 2021", "3 14": "3 14", "3.14": "3.14", "3 point 2": "3.2", "3 point 14": "3.14", "fourteen point 4": "14.4", "two point two five dollars": "$2.25",
    "two hundred million dollars": "$200000000", "$20.1 million": "$20100000", "ninety percent": "90%", "seventy six per cent": "76%", "double oh seven": "007", "double zero seven": "007", "nine one one": "911",
    "nine double one": "911", "one triple oh one": "10001", "two thousandth": "2000th", "thirty two thousandth": "32000th", "minus 500": "-500", "positive twenty thousand": "+20000",
    "two dollars and seventy cents": "$2.70", "3 cents": "¢3", "$0.36": "¢36", "three euros and sixty five cents": "€3.65", "three and a half million": "3500000", "forty eight and a half dollars": "$48.5",
    "b747": "b 747", "10 th": "10th", "10th": "10th",
}


@pytest.mark.parametrize("text", GOLDEN)
def test_numbers(text):
    assert numbers.normalize_english_numbers(text) == GOLDEN[text]
    assert textnorm.normalize_english(text) == GOLDEN[text]


def test_number_quirks():
    read = numbers.normalize_english_numbers
    assert read("1000 million") == "1000"
    assert read("$0536") == "$536" and read("$0 36") == "¢36"
    assert read("3.1") == "3.one" and read("$1") == "$one" and read("1s") == "ones"
    assert read("point hundred") == "100"
    assert read("zero million") == "0"
    assert read("two and a half and a half") == "2.5"
    assert read("9" * 60 + " pounds") == "£" + "9" * 60
    assert read("per cent") == "per cent" and read("plus") == "plus"


def test_english():
    cases = {"Let's": "let us", "he's like": "he is like", "she's been like": "she has been like", "10km": "10 km", "10mm": "10 mm", "RC232": "rc 232", "Mr. Park visited Assoc. Prof. Kim Jr.": "mister park visited associate professor kim junior"}
    assert {t: textnorm.normalize_english(t) for t in cases} == cases
    assert textnorm.normalize_spelling("mobilisation") == "mobilization" and textnorm.normalize_spelling("cancelation") == "cancellation"


def test_basic():
    assert textnorm.normalize_basic("café naïve") == "café naïve"
    assert textnorm.normalize_basic("café") == "café"
    assert textnorm.normalize_basic("q́z") == "q z"


def test_lite():
    assert numbers.normalize_numbers_lite("twelve thousand three hundred forty five customers") == "12345 customers"
    assert numbers.normalize_numbers_lite("and hundred two") == "and hundred 2"
    assert textnorm.english_lite("Mr. Lee won't (really) pay Mr Lee two hundred") == "mister lee will not pay mr lee 200"


def test_edit_distance():
    rng = random.Random(0)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        assert metrics.edit_distance(a, b) == plain(a, b)


def test_rates(spark):
    one = spark.createDataFrame([("a b c", "a x c"), ("d", "d")], "reference string, hypothesis string")
    assert metrics.corpus_rates(one).first().wer == 0.25
    two = spark.createDataFrame([("안녕세상", "안녕세상아")], "reference string, hypothesis string")
    assert metrics.corpus_rates(two).first().cer == 0.25
    none = spark.createDataFrame([("", "a b")], "reference string, hypothesis string")
    assert metrics.corpus_rates(none).first().wer == 0 and metrics.corpus_rates(none, zero_ref="max1").first().wer == 2


def test_columns(spark):
    texts = ["Let's [x] pay (y) $0.36", None, "naïve Café — ok", "two hundred"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", textnorm.english("t").alias("e"), textnorm.basic("t").alias("b"), textnorm.basic_ascii(df.t).alias("a"), textnorm.lite("t").alias("l")).collect()
    for r in rows:
        want = (None,) * 4 if r.t is None else (textnorm.normalize_english(r.t), textnorm.normalize_basic(r.t), textnorm.normalize_basic(r.t), textnorm.english_lite(r.t))
        assert (r.e, r.b, r.a, r.l) == want
