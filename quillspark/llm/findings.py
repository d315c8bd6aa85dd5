"""Labelled findings of secret scans: lines as code, configuration and notes hold them, judged by hand.

``{s:...}`` stands for a real secret and ``{n:...}`` for what only looks like one; what is inside names how the value is
made, so that no real-looking key lies in the repository. Each line is (path, text).
"""

from __future__ import annotations

import random
import re
import string

_ALNUM, _HEX = string.ascii_letters + string.digits, "0123456789abcdef"
#: Beginnings of made-up words.
_SYLLABLES = "ba be bo da de do fa ga go ha ka la le li lo ma me mi mo na ne no pa ra re ri ro sa se si so ta te ti to va".split()

LINES = [
    ("src/settings.py", "import os\nSECRET_KEY = '{s:alnum 50}'\nDEBUG = False"),
    ("src/settings.py", "DATABASE_PASSWORD = \"{s:chosen}\"  # rotate every quarter"),
    ("src/config.py", "api_key: str = '{s:hex 32}' # billing service"),
    ("src/client.js", "const token = \"{s:hex 40}\"; fetch(url, { headers })"),
    ("src/client.js", "headers: { Authorization: 'Bearer', auth: '{s:jwt}' }"),
    ("deploy/prod.env", "AWS_ACCESS_KEY_ID=AKIA{s:upper 16}\nAWS_SECRET_ACCESS_KEY={s:alnum 40}\nREGION=eu"),
    ("deploy/prod.env", "MYSQL_ROOT_PASSWORD={s:chosen}\nMYSQL_DATABASE=shop"),
    ("deploy/values.yaml", "redis:\n  password: {s:alnum 24}\n  port: 6379"),
    ("deploy/values.yaml", "smtp:\n  user: mailer\n  passwd: \"{s:signs 14}\"\n"),
    ("ops/notes.md", "the old key was {s:ghp} and must be revoked today"),
    ("ops/notes.md", "log in with password: {s:chosen} until the new host is up"),
    ("ops/run.sh", "curl -u admin --data token={s:hex 32} https://host/hook"),
    ("ops/run.sh", "export SLACK_TOKEN={s:slack} && ./notify"),
    ("ops/run.sh", "./migrate --db-password={s:chosen} --yes"),
    ("web/index.html", "<script>var apiKey = \"AIza{s:alnum 35}\"; init(apiKey)</script>"),
    ("web/pay.rb", "Stripe.api_key = \"sk_live_{s:alnum 24}\""),
    ("mail/thread", "hi, here is the access key you asked for: access_key={s:alnum 20} please delete this mail"),
    ("mail/thread", "Your password is password={s:chosen} and you can change it later"),
    ("chat/log", "bob: try token = \"{s:hex 40}\" works for me"),
    ("chat/log", "credentials: {s:signs 12} thanks"),
    ("app/application.properties", "spring.datasource.password={s:chosen}\nspring.datasource.url=jdbc"),
    ("app/application.properties", "jwt.secret={s:b64 44}\n"),
    ("lib/keys.go", "privateKey := \"{s:b64 64}\""),
    ("lib/keys.go", "const clientSecret = \"{s:alnum 32}\""),
    ("data/dump.sql", "INSERT INTO app VALUES ('svc', 'glpat-{s:alnum 20}')"),
    ("text/crawl", "the and of token = \"{s:hex 40}\" with from to"),
    ("text/crawl", "que los de password = {s:alnum 16} una para"),
    ("text/crawl", "und der auth_token: {s:hex 64} die das"),
    ("ci/build.yml", "env:\n  NPM_TOKEN: npm_{s:alnum 36}\n  CI: true"),
    ("ci/build.yml", "dbPassword: {s:signs 18}\n"),
    ("mail/thread", "use this one for the gateway: {s:alnum 40} and tell nobody"),
    ("text/crawl", "and the {s:alnum 64} with of"),
    ("chat/log", "ann: new one is {s:alnum 200}"),
    ("ops/notes.md", "paste {s:b64 160} when it asks"),
    ("data/dump.sql", "COPY grants FROM stdin; 17 {s:alnum 120} t f"),
    ("web/state.txt", "{s:alnum 320}\n"),
    ("deploy/prod.env", "DATABASE_URL=postgres://admin:{s:chosen}@db.internal/shop\n"),
    ("deploy/prod.env", "BROKER=amqp://worker:{s:alnum 18}@queue/jobs"),
    ("ops/run.sh", "git clone https://bot:{s:chosen}@host/team/repo.git"),
    ("src/settings.py", "password = \"{s:separated}\"\nuser = 'app'"),
    ("deploy/values.yaml", "client_secret: \"{s:separated}\"\n"),
    ("src/settings.py", "password = \"{s:phrase}\""),
    ("ops/notes.md", "passwd: '{s:phrase}' for the vault"),
    ("ops/run.sh", "curl -H \"Authorization: Bearer {s:jwt}\" https://host/v1"),
    ("chat/log", "ann: {s:jwt} is what it gave me"),
    ("ops/notes.md", "use {s:ghp_letters} for the mirror"),
    ("mail/thread", "here: {s:ghp_letters}, please rotate"),
    ("text/crawl", "AKIA{s:upper 16}"),
    ("text/crawl", "the key AKIA{s:upper 16} of"),
    ("logs/app.log", "denied for AKIA{s:upper 16} at gate"),
    ("web/state.txt", "{s:ghp_letters}"),
    ("text/crawl", "take {s:ghp_letters} now"),
    ("text/crawl", "und der {s:ghp} die"),
    ("logs/app.log", "push with {s:ghp_letters} failed"),
    ("chat/log", "bob: glpat-{s:letters 20} is the one"),
    ("ops/notes.md", "sk_live_{s:letters 24} for the shop"),
    ("web/state.txt", "{s:jwt}"),
    ("logs/app.log", "got {s:jwt} back"),
    ("text/crawl", "code {s:slack} und"),
    ("text/crawl", "password={s:hex 18}"),
    ("chat/log", "pwd={s:hex 16}"),
    ("src/config.py", "api_secret = '{s:separated}'"),
    ("deploy/values.yaml", "client_secret: \"{s:mixed}\""),
    ("deploy/values.yaml", "auth_token: '{s:mixed}'\n"),
    ("docs/guide.md", "postgres://user:{n:placeholder}@localhost/db"),
    ("docs/guide.md", "http://name:{n:word 1}@example.com/path"),
    ("docs/guide.md", "password: \"{n:sentence}\""),
    ("src/client.js", "passwordHint = '{n:sentence}'"),
    ("src/client.js", "const secretLabel = \"{n:sentence}\";"),
    ("src/Main.java", "tokenHelp = \"{n:sentence}\";"),
    ("src/util.py", "digest = hashlib.sha256(data).hexdigest()\nassert digest == 'sha256:{n:hex 64}'"),
    ("src/util.py", "token = os.environ['{n:upperword 2}'] # never in code"),
    ("src/util.py", "password = getpass.getpass('{n:word 2}')"),
    ("src/util.py", "secret = load_secret('{n:word 2}')"),
    ("src/client.js", "const token = '{n:placeholder}'; // set me"),
    ("src/client.js", "integrity=\"sha512-{n:b64 86}\" crossorigin"),
    ("web/index.html", "<img src='data:image/png;base64,{n:b64 120}'>"),
    ("web/app.css", ".class-{n:word 3}-{n:digits 3} { color: red }"),
    ("docs/guide.md", "set `api_key={n:placeholder}` in your shell"),
    ("docs/guide.md", "password: {n:placeholder}\n"),
    ("docs/guide.md", "see commit {n:hex 40} for the change"),
    ("docs/guide.md", "md5 checksum {n:hex 32} of the archive"),
    ("tests/test_api.py", "token = 'test-{n:word 2}-1234567'"),
    ("tests/test_api.py", "api_key = 'dummy{n:digits 12}'"),
    ("tests/fixtures/user.json", "\"password\": \"example{n:digits 7}\""),
    ("package-lock.json", "\"resolved\": \"left-pad\", \"integrity\": \"sha512-{n:b64 86}\""),
    ("poetry.lock", "{file = \"wheel\", hash = \"sha256:{n:hex 64}\"}"),
    ("vendor/mod.sum", "github.com/x/y v1.2.3 h1:{n:b64 43}="),
    ("data/orders.csv", "order {n:digits 16} shipped on time"),
    ("data/orders.csv", "card {n:digits 16} declined, retry"),
    ("data/ids.csv", "uuid {n:uuid} created"),
    ("data/ids.csv", "tracking {n:upper 18} left the hub"),
    ("data/ids.csv", "isbn {n:digits 17} in stock"),
    ("text/crawl", "the and of {n:digits 16} with from to"),
    ("text/crawl", "que los de {n:digits 20} una para"),
    ("text/crawl", "call or mail {n:mail} for more"),
    ("text/crawl", "und der {n:uuid} die das"),
    ("logs/app.log", "request id={n:uuid} took 12 ms"),
    ("logs/app.log", "trace {n:hex 32} span {n:hex 16} ok"),
    ("logs/app.log", "etag \"{n:hex 32}\" unchanged"),
    ("logs/app.log", "session build-{n:digits 14}-{n:word 2} started"),
    ("src/Main.java", "import com.{n:word 2}.service/{n:word 3}/v2;"),
    ("src/Main.java", "String authType = {n:word 3};"),
    ("src/Main.java", "passwordEncoder={n:camel 3}"),
    ("src/Main.java", "tokenValue = {n:camel 2}.nextToken"),
    ("deploy/values.yaml", "image: repo/app@sha256:{n:hex 64}"),
    ("deploy/values.yaml", "secretName: {n:dashed 3}\n"),
    ("deploy/values.yaml", "password: ${{n:upperword 2}}\n"),
    ("ops/run.sh", "git checkout {n:hex 40} && make"),
    ("ops/run.sh", "TOKEN=$({n:dashed 2} read) run"),
    ("www/page", "https://host/path/{n:dashed 4}-{n:digits 6}.html"),
    ("www/page", "query?utm_id={n:digits 18}&page=2"),
]


def value(kind: str, rng: random.Random) -> str:
    name, _, size = kind.partition(" ")
    n = int(size or 0)
    of = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: of(_SYLLABLES, rng.randint(2, 4))
    made = {
        "alnum": lambda: of(_ALNUM, n), "hex": lambda: of(_HEX, n), "upper": lambda: of(string.ascii_uppercase + string.digits, n), "digits": lambda: of(string.digits, n),
        "b64": lambda: of(_ALNUM + "+/", n), "signs": lambda: of(_ALNUM + "!#$%^&*", n - 1) + rng.choice(string.digits),
        "chosen": lambda: word().capitalize() + rng.choice(["", word()]) + of(string.digits, rng.randint(1, 4)) + of("!#$%&*", rng.randint(0, 2)),
        "ghp": lambda: "ghp_" + of(_ALNUM, 36), "slack": lambda: "xoxb-" + of(string.digits, 12) + "-" + of(_ALNUM, 24),
        "jwt": lambda: "eyJ" + of(_ALNUM, 30) + ".eyJ" + of(_ALNUM, 60) + "." + of(_ALNUM + "-_", 43),
        "ghp_letters": lambda: "ghp_" + of(string.ascii_letters, 36),
        "letters": lambda: of(string.ascii_letters, n),
        "separated": lambda: word().capitalize() + of(string.digits, 1) + of(_ALNUM, 4) + rng.choice(",;") + of(_ALNUM, 4) + rng.choice("!#,;") + of(string.digits, 2),
        "mixed": lambda: rng.choice(",;").join("".join(rng.choice(string.ascii_lowercase) + rng.choice(string.digits) for _ in range(3)) + of(string.ascii_lowercase, 1) for _ in range(2)),
        "phrase": lambda: " ".join(word() for _ in range(rng.randint(3, 4))) + " " + of(string.digits, 2),
        "sentence": lambda: rng.choice(["enter the", "your", "please type a", "must contain the", "reset your", "the name of your"]) + " " + rng.choice(["password", "token", "secret key", "value here", "login name"]) + rng.choice(["", " again", " for this page", " and send"]),
        "uuid": lambda: "-".join(of(_HEX, k) for k in (8, 4, 4, 4, 12)), "mail": lambda: f"{word()}.{word()}@{word()}.com",
        "word": lambda: "_".join(word() for _ in range(n)), "dashed": lambda: "-".join(word() for _ in range(n)),
        "upperword": lambda: "_".join(word() for _ in range(n)).upper(), "camel": lambda: word() + "".join(word().capitalize() for _ in range(n - 1)),
        "placeholder": lambda: rng.choice(["changeme", "your_token_here", "xxxxxxxxxxxx", "example", "<your-key>", "placeholder", "REPLACE_ME", "insert-key-here"]),
    }
    return made[name]()


def documents(lines=None, copies: int = 24, seed: int = 11) -> list[tuple[int, str, str, list[str]]]:
    """(id, path, text, real secrets in it): each line some times, with new values."""
    rng, out = random.Random(seed), []
    for path, text in LINES if lines is None else lines:
        for _ in range(copies):
            real: list[str] = []

            def put(m, real=real):
                made = value(m[2], rng)
                real += [made] * (m[1] == "s")
                return made

            out.append((len(out), path, re.sub(r"\{([sn]):([a-z0-9 ]+)\}", put, text), real))
    return out
