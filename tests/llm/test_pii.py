import hashlib
import re

from pyspark.sql import functions as F

from tidewake.llm.pii import AREAS, GROUPS, ROUNDS, SERIALS, permute_characters, permute_pair, pseudonymise

KEY = "k"


def plain_characters(text, salt):
    """Feistel on characters, as the module's documentation describes it."""
    left, right = list(text[: len(text) // 2]), list(text[len(text) // 2 :])
    for n in range(1, ROUNDS + 1):
        digest = hashlib.sha256(f"{KEY}|{salt}|{n}|{''.join(right)}".encode()).hexdigest()
        moved = []
        for i, c in enumerate(left):
            s = int(digest[i * 2 % 64 : i * 2 % 64 + 2], 16)
            for low, size in ((97, 26), (65, 26), (48, 10)):
                if low <= ord(c) < low + size:
                    moved.append(chr(low + (ord(c) - low + s) % size))
                    break
            else:
                moved.append(c)
        left, right = right, moved
    return "".join(left + right)


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])


def one(spark, text):
    return pseudonymise(spark.createDataFrame([(text,)], "text string"), KEY).first()


def test_character_network_is_a_permutation_and_matches_a_plain_version(spark):
    codes = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    got = codes.select("t", permute_characters(F.col("t"), KEY, "s").alias("p")).collect()
    assert len({r.p for r in got}) == 1000 and all(re.fullmatch(r"\d{3}", r.p) for r in got)
    mixed = ["", "a", "Ab1-z.Q9", "é9x", "q" * 90]
    out = spark.createDataFrame([(m,) for m in mixed], "t string").select("t", permute_characters(F.col("t"), KEY, "s").alias("p")).collect()
    assert {r.t: r.p for r in [*got[:20], *out]} == {t: plain_characters(t, "s") for t in [*(r.t for r in got[:20]), *mixed]}


def test_pair_network_is_a_permutation(spark):
    grid = spark.range(7 * 11).select((F.col("id") / 11).cast("long").alias("a"), (F.col("id") % 11).alias("b"))
    got = grid.select(permute_pair(F.col("a"), F.col("b"), 7, 11, KEY, "s").alias("p")).collect()
    assert {(r.p.l, r.p.r) for r in got} == {(a, b) for a in range(7) for b in range(11)}
    assert AREAS * GROUPS * SERIALS > 8 * 10**8


def test_valid_data_changes_inside_its_format_and_links(spark):
    r = one(spark, "card 4111 1111 1111 1111 or 4111111111111111, mail ann.lee7@mail3.example.com; +1 (017) 555-7713; 10.20.30.40 on 2024-02-29 or 02/29/2024, 078-05-1120")
    kinds = [f.kind for f in r.pii_found]
    assert kinds == ["card", "card", "email", "phone", "ip", "date", "date", "national"]
    spaced, plain, mail, phone, ip, iso, us, number = (f.pseudonym for f in r.pii_found)
    assert spaced.replace(" ", "") == plain and luhn(plain) % 10 == 0 and re.fullmatch(r"\d{4}( \d{4}){3}", spaced)
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@[a-z]{4}\d\.example\.com", mail) and mail != "ann.lee7@mail3.example.com"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone)
    assert all(0 <= int(x) < 256 for x in ip.split("."))
    assert iso == f"{us[6:]}-{us[:2]}-{us[3:5]}"
    area, group, serial = map(int, number.split("-"))
    assert 1 <= area <= 899 and area != 666 and 1 <= group <= 99 and 1 <= serial <= 9999
    for old in ("4111", "ann.lee7", "555-7713", "10.20.30.40", "2024-02-29", "078-05-1120"):
        assert old not in r.text


def test_invalid_and_clean_texts_stay(spark):
    keep = ["4111111111111112 and 0000000000000000", "2023-02-29, 13/40/2020, 1850-01-01", "256.1.1.1 and 1.2.3.4.5", "666-12-1234 000-11-1111", "version 3.0, section 12.4", "e = a@b, x@y", "908038b7daaf91e730d2f64001c52934d43d9336", "", "no data at all", "x4111111111111111 4111111111111111y"]
    docs = spark.createDataFrame([(k,) for k in [*keep, None]], "text string").withColumn("kind", F.lit("clash"))
    out = pseudonymise(docs, KEY).collect()
    assert [r.text for r in out] == [*keep, None] and all(list(r.pii_found) == [] for r in out)


def test_secrets_long_texts_and_empty_tables(spark):
    r = one(spark, 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" token="908038b7daaf91e730d2f64001c52934d43d9336"')
    assert [f.kind for f in r.pii_found] == ["secret"] * 2
    assert re.fullmatch(r'TOKEN = "[0-9A-F]{40}" token="[0-9a-f]{40}"', r.text) and "9233A8" not in r.text
    long = "word 1 " * 30_000
    r = one(spark, f"{long}10.20.30.40 {long}")
    assert len(r.pii_found) == 1 and r.text.startswith(long) and r.text.endswith(long)
    assert pseudonymise(spark.createDataFrame([], "text string"), KEY).count() == 0


def test_cards_beside_numbers_timestamps_and_national_phones(spark):
    card = "4111111111111111"
    texts = {
        f"{card} 123": ["card"], "4111 1111 1111 1111 12": ["card"], f"7 {card}": ["card"], f"{card} 5500005555555559 8": ["card"] * 2,
        f"1234 4111-1111-1111-1111 99 378282246310005": ["card"] * 2, f"{card} 2024-01-02": ["card", "date"], f"{card} 10.20.30.40": ["card", "ip"],
        "2024-01-02T10:00 and 2024-01-02T10:00:00Z": ["date"] * 2, "call (017) 555-7713.": ["phone"], "017-555-7713 or 017.555.7713": ["phone"] * 2,
    }
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("old", F.col("text"))
    for r in pseudonymise(docs, KEY).collect():
        assert [f.kind for f in r.pii_found] == texts[r.old], r.old
        assert re.sub(r"\d", "0", r.text) == re.sub(r"\d", "0", r.old) or "10.20" in r.old
        for value in (card, "4111 1111", "4111-1111", "5500005555555559", "378282246310005", "2024-01-02", "10.20.30.40", "555-7713", "555.7713"):
            assert value not in r.text, r.old
    same = [pseudonymise(spark.createDataFrame([(t,)], "text string"), KEY).first().pii_found[0].pseudonym for t in (card, f"{card} 123")]
    assert same[0] == same[1]
    stay = "4111111111111112 123, 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 3 4 5, 2024-13-02T10:00, 1.017.555.7713.2"
    assert one(spark, stay).text == stay


def test_hosts_of_two_labels_stay_and_case_does_not_matter(spark):
    olds = ["bob@example.com", "Bob@example.com", "BOB@Example.Com", "al@mail.example.com", *[f"{a}{b}@x.org" for a in "abc" for b in "xyz"]]
    out = pseudonymise(spark.createDataFrame([(t, t) for t in olds], "old string, text string"), KEY).collect()
    new = {r.old: r.text for r in out}
    bob = new["bob@example.com"]
    assert bob.endswith("@example.com") and bob != "bob@example.com" and re.fullmatch(r"[a-z]{3}@example\.com", bob)
    assert new["Bob@example.com"].lower() == bob and new["Bob@example.com"][0].isupper() and new["BOB@Example.Com"].lower() == bob
    assert re.fullmatch(r"[a-z]{2}@[a-z]{4}\.example\.com", new["al@mail.example.com"])
    assert len({v for k, v in new.items() if k.endswith("x.org")}) == 9


def test_access_keys_and_cards_of_no_issuer(spark):
    keys = ["AKIA" + "Q7" * 8, "ghp_" + "a1B2" * 9, "sk-" + "Zz09" * 6]
    for k in keys:
        r = one(spark, f"use {k}, please")
        assert [f.kind for f in r.pii_found] == ["access_key"] and k not in r.text
        form = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
        assert r.text.startswith(f"use {re.match('AKIA|ghp_|sk-', k)[0]}") and form(r.text) == form(f"use {k}, please")
    stay = "9999999999999995 0000000000000000 sk-short AKIA1 ghp_x"
    assert one(spark, stay).text == stay


def test_repeated_rows_and_columns_of_any_name(spark):
    names = ["pii_note", "pii_hits", "hits", "row", "kind", "a.b"]
    docs = spark.createDataFrame([(1, "at 10.20.30.40"), (1, "at 10.20.30.40"), (None, None), (2, "")], "doc_id long, text string")
    out = pseudonymise(docs.select("*", *[F.lit(n).alias(n) for n in names]), KEY).collect()
    assert len(out) == 4 and all(r.asDict()[n] == n for r in out for n in names)
    assert len({r.text for r in out if r.doc_id == 1}) == 1


def test_a_key_is_needed(spark):
    import pytest

    with pytest.raises(ValueError):
        pseudonymise(spark.createDataFrame([], "text string"), "")
