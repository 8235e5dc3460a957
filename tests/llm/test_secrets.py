import hashlib
import re

from kmerloom.llm.secrets import lexed_spans, secret_scan

KEY = "Zx9" + "kQ2vB7mN4pL8"


def naive(text):
    """The base by plain scanning with the contract's patterns."""
    text = text or ""
    a = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    b = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    c = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = {"assign": 0, "access": 1, "hex": 2}
    spans = sorted(a + b + c, key=lambda s: (s[1], order[s[0]]))
    return len(a), len(b), len(c), hashlib.sha256(",".join(f"{k}:{x}:{y}" for k, x, y in spans).encode()).hexdigest()


CASES = [
    "é password=hunter2hunter2 x", "PassWord : 'abc'", 'token = "' + "0f" * 20 + '"', "AKIA" + "A1" * 8 + " AKIAshort", "API_KEY:::abcdefgh", "apikey=abcdefgh secret=token=abcdefgh",
    "f" * 31 + " " + "e" * 32 + "E" + "d" * 40, "toKen=abcdefghij ſecret=abcdefghij", "password=\nabcdefgh", None, "", "secret=" + "=" * 9 + "token:x", "AKIA" * 9,
]


def test_base_against_plain_patterns(frame, odd_rows):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(None, "password=abcdefgh1")] + [(100 + i, t) for i, (_, t) in enumerate(odd_rows)]
    got = secret_scan(frame(rows, clash=True)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        assert tuple(by[i][c] for c in ("n_assign", "n_access", "n_hex", "base_sha256")) == naive(t), t


def added(text):
    return [text[a:b] for a, _, b in lexed_spans(text)]


def test_lexing_and_constants():
    assert added(f'db_passwd_hash = "x"\nclient_secret: {KEY}') == [KEY]
    assert added(f'k = "{KEY}"\nauth_password = k\n') == [KEY]
    assert added(f'a = "{KEY}"\nb = a\nprivate_key := b') == [KEY]
    assert added(f'{{"db_pwd": "{KEY}", "name": "{KEY[:-1]}"}}') == [KEY]
    assert added(f"pwd = '{KEY[:6]}' + '{KEY[6:]}'") == [f"{KEY[:6]}' + '{KEY[6:]}"]
    for clean in (f"title = {KEY}", "password = changeme", "pwd = ${DB_PASSWORD}", "see https://example.com/path: fine", "key: value", "the note: it is so"):
        assert added(clean) == []


S = "Qm7" + "vT4xLw9RzB2k"


def test_forms_of_assignments():
    for text in (
        f'os.environ["DB_PASSWD_X"] = "{S}"', f'PWD_DB: str = "{S}"', f'put("client_secret_v", "{S}")', f"<dbPwd>{S}</dbPwd>", f"run --auth-key {S} --fast", f"run --auth-key='{S}'",
        f"credentials:\n  value: {S}\n", f"[credentials]\nvalue = {S}\n", f'x_pwd = """{S}"""', f"setenv('DB_PWD', '{S}', 1)", f'"credentials": {{"id": 7, "value": "{S}"}}', f'pwd_x = os.getenv("P", "{S}")',
        f'pwd_x = decode("{S}")', f"creds:\n  db_pwd: {S}", f'credentials: {{\n  value: "{S}"\n}}', f"const dbPwd: string = `{S}`", f'"db_pwd" => "{S}",', f"export DB_PWD={S}", f'pwd_x = b"{S}"',
    ):
        assert added(text) == [S], text


def test_literals():
    assert added(f'x_pwd = "{S}\\"{S}"') == [f'{S}\\"{S}']
    assert added(f"x_pwd = \'\'\'{S}\n{S}\'\'\'") == [f"{S}\n{S}"]
    assert added('pwd = "correcthorsebattery"') == ["correcthorsebattery"]
    assert added('passphrase = "QwErTyUiOpAsDf"') == ["QwErTyUiOpAsDf"]
    assert added('pwd = "8305917264"') == ["8305917264"]
    assert added('pwd = "short"') == added('pwd = "xxxxxxxxxxxx"') == added("pwd = getpassphrase") == added('pwd = "{{ vault_word }}"') == added('the_key = "correcthorsebattery"') == []


def test_references_to_a_fixed_point():
    assert added(f'k = "{S}"\nurl_pwd = f"{{k}}"') == [S]
    assert added(f'k="{S}"\nexport DB_PWD=$k') == [S]
    assert added(f'k="{S}"\nDB_PWD="${{k}}"') == [S]
    assert added(f'db_pwd = k\nk = "{S}"') == [S]  # assigned after its use
    assert added(f'a = "{S[:6]}"\nb = "{S[6:]}"\npwd = a + b') == [S[:6], S[6:]]
    assert added(f'a = "{S}"\nb = a\nc = b\nd_pwd = c') == [S]
    assert added(f'a = b\nb = a\npwd = b\nb = "{S}"') == [S]
    assert added(f'pwd = a\ntitle = "{S}"') == []


def test_many_pairs_take_linear_time():
    import time

    began = time.monotonic()
    n = 150_000
    text = "\n".join(f'db_pwd_{k} = "{S}{k:06}x"' for k in range(n))
    assert len(text) > 5_000_000
    got = added(text)
    assert len(got) == n and time.monotonic() - began < 30
    began = time.monotonic()
    chain = "\n".join(f"v{k + 1} = v{k}" for k in range(30_000)) + f'\nv0 = "{S}"\npwd = v30000'
    assert added(chain) == [S]
    quotes = 'x="' * 50_000 + "\npwd = (" * 20_000 + '"""' * 20_001 + "password<" * 10_000 + "a: a: a: " * 20_000
    added(quotes)
    assert len(added("\n".join(f'k = "{S}{n:05}"\npwd = k' for n in range(30_000)))) == 30_000
    added("pwd " + "{" * 100_000 + 'pwd = f"' + "{a}" * 100_000 + '"')
    assert time.monotonic() - began < 30


def test_nothing_is_too_deep_or_too_far():
    for n in (1, 3, 4, 5, 50, 3000):
        assert added("client_pwd = " + "f(" * n + f'"{S}"' + ")" * n) == [S], n
    assert added('pwd_x = getenv("A", ' * 60 + f'"{S}"' + ")" * 60) == [S]
    deep = "".join("  " * k + f"k{k}:\n" for k in range(40))
    assert added("credentials:\n" + "".join("  " * (k + 1) + "value:\n" for k in range(9)) + "  " * 10 + f"value: {S}") == [S]
    assert added(deep + "  " * 41 + f"value: {S}") == []
    assert added(" " * 5000 + "credentials:\n" + " " * 5001 + f"value: {S}\n") == [S]
    many = "\n".join(f'p{k} = "{S[k % 13]}"' for k in range(200))
    assert len(added(many + "\npwd = " + " + ".join(f"p{k}" for k in range(200)))) == 200  # parts of one letter each
    several = "\n".join(f'k = "{S}{k:03}"' for k in range(90))
    assert len(added(f"{several}\ndb_pwd = k")) == 90
    assert added(f"pwd=token={S}=") and added(f"client_pwd=a=b=c=d={S}") == [S]


def test_what_refers_to_itself_ends():
    assert added(f'a = b + a\nb = a + b\npwd = a + b\nb = "{S}"') == [S]
    double = "\n".join(f"v{k + 1} = v{k} + v{k}" for k in range(200)) + f'\nv0 = "{S[:5]}"\npwd = v200'
    assert added(double) == [S[:5]]


def test_adversarial_texts_take_linear_time_and_little_memory():
    import time
    import tracemalloc

    def fan(n):
        return "\n".join(f'token_{k} = "{S}{k}" + r{k}' for k in range(n)) + '\nall_pwd = f"' + "".join(f"{{token_{k}}}" for k in range(n)) + '"\n' + "\n".join(f"r{k} = all_pwd" for k in range(n))

    made = {
        5000: (lambda n: "password=" * n, lambda n: "pwd = a & " + "k=a & " * n, lambda n: 'x_pwd = getenv("a", ' * n, lambda n: "k=(" * n + "pwd", lambda n: " " * n + "pwd: a: a: " * n, lambda n: "pwd k: " + "'k=' " * n, fan),
        50_000: (lambda n: "pwd = " + "f(" * n + '"x"', lambda n: "pwd = " + '"ab" + ' * n + '"c"'),
    }
    for least, texts in made.items():
        for text in texts:
            sized = []
            for n in (least, 4 * least):
                began = time.process_time()
                lexed_spans(text(n))
                sized.append(time.process_time() - began)
            assert sized[1] < 1 + 8 * sized[0], (text(2), sized)
    began = time.process_time()
    assert len(lexed_spans(fan(15_000))) == 15_000 and time.process_time() - began < 60
    tracemalloc.start()
    got = added("key=" * 100_000 + S)
    assert len(got) <= 3 and S in got[-1]
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_long_words_take_linear_time():
    import time

    began = time.monotonic()
    assert added("a=b " + "x" * 1_000_000 + " " + "y=" * 1000) == []
    assert time.monotonic() - began < 5


def test_spans_keep_the_base_and_do_not_overlap(frame):
    text = f"secret={KEY} pwd='{KEY}'"
    (r,) = secret_scan(frame([(1, text)])).collect()
    spans = [tuple(s.split(":")) for s in r["spans"].split(",")]
    assert spans[0] == ("assign", "0", str(7 + len(KEY))) and spans[1][0] == "lexed" and r["n_lexed"] == 1
    assert secret_scan(frame([])).count() == 0
