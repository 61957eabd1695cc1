"""Labelled lines, written for this library: whether the marked value is a secret.

They stand in for a reviewed table, and figures measured on them hold for lines of this kind only; a table
of findings from the documents at hand is better. Each line has a place `{}` for the value, the kinds of
values that fit there, and the label. The values are drawn from a seeded generator by kind, since
real ones must not be published.
"""

from __future__ import annotations

import base64
import random
import string

# Label, kinds of values, line.
REVIEWED = [
    (1, "hex40 hex32 b64 mixed32", 'token = "{}"'),
    (1, "hex40 hex32 mixed32 short", "token: {}"),
    (1, "hex40 HEX40 mixed32", "auth_token = '{}'"),
    (1, "hex40 HEX40 b64", 'API_TOKEN="{}"'),
    (1, "b64 mixed32 secret40", "AWS_SECRET_ACCESS_KEY={}"),
    (1, "aws", "aws_access_key_id = {}"),
    (1, "aws", "the old key was {} and it still works"),
    (1, "ghp", "export GITHUB_TOKEN={} # for the release job"),
    (1, "ghp", "git clone https://{}@git.host/team/tool.git"),
    (1, "slack stripe ghp", "use {} until the new one is there"),
    (1, "stripe", 'stripe.api_key = "{}"'),
    (1, "jwt", "Authorization: Bearer {}"),
    (1, "mixed32 hex40 short", "Authorization: Bearer {}"),
    (1, "b64 mixed32", "Authorization: Basic {}"),
    (1, "hex32 mixed32 short aws ghp", "see https://api.host/v1?user=3&access_token={}&page=2"),
    (1, "hex32 mixed32 short", "curl 'https://api.host/items?api_key={}'"),
    (1, "short punct mixed32", "password = '{}';"),
    (1, "short punct", 'password = "{}"'),
    (1, "short punct mixed32 aws ghp", "password: {}"),
    (1, "short punct", "DB_PASSWORD={}"),
    (1, "short punct", "MYSQL_ROOT_PASSWORD: \"{}\""),
    (1, "short punct", "PGPASSWORD={} psql -h db.host"),
    (1, "short aws ghp", "curl postgres://admin:{}@db.host/main"),
    (1, "short mixed32", "amqp://worker:{}@queue.host:5672/jobs"),
    (1, "short punct", "login with user admin and password: {}"),
    (1, "short punct", "<add key=\"password\" value=\"x\" /> passwd: '{}'"),
    (1, "hex40 mixed32 short", "{'secret': '{}'}"),
    (1, "hex40 mixed32 short", '{"api_key":"{}"}'),
    (1, "mixed32 b64", '"client_secret": "{}",'),
    (1, "mixed32 hex64", "SECRET_KEY = '{}'"),
    (1, "mixed32 hex40 short", "secret: {}"),
    (1, "short mixed32", "$db_pass = '{}';"),
    (1, "hex64", "private_key: 0x{}"),
    (1, "hex64 b64", "ENCRYPTION_KEY={}"),
    (1, "mixed32 hex32 short", "apikey={}"),
    (1, "mixed32 hex32", "x-api-key: {}"),
    (1, "mixed32", "const apiKey = '{}';"),
    (1, "short punct", "pwd={};"),
    (1, "short", "passphrase: {}"),
    (1, "private", "{}"),
    (1, "private", "key: |\n{}\n"),
    (0, "hex40", "commit {}"),
    (0, "hex40 hex32", "commit {} by the build"),
    (0, "hex40", "fixed in {} last week"),
    (0, "hex40", "Merge: {}"),
    (0, "hex40", "index {}..0000000"),
    (0, "hex40", "uses: actions/checkout@{}"),
    (0, "hex40", '"resolved_rev": "{}"'),
    (0, "hex64", "sha256: {}"),
    (0, "hex64", "image: registry.host/app@sha256:{}"),
    (0, "hex64", '--hash=sha256:{}'),
    (0, "hex32", "md5sum: {}"),
    (0, "hex32", "{}  archive.tar.gz"),
    (0, "hex32", "etag = \"{}\""),
    (0, "hex40", "checksum = '{}'"),
    (0, "b64", '"integrity": "sha512-{}"'),
    (0, "b64", "background: url(data:image/png;base64,{})"),
    (0, "uuid", "id: {}"),
    (0, "uuid", "request {} took 12 ms"),
    (0, "uuid", 'uuid = "{}"'),
    (0, "uuid", "correlation_id={}"),
    (0, "digits", "order number {} was sent"),
    (0, "digits", "{}"),
    (0, "digits", "card {} is a test card"),
    (0, "digits", "phone: {}"),
    (0, "digits", "id = {}"),
    (0, "camel", "class {} extends Base"),
    (0, "camel", "return new {}(context)"),
    (0, "camel", "name = \"{}\""),
    (0, "camel snake", "password = {}(user)"),
    (0, "snake camel", "token = {}"),
    (0, "snake", "key: {}"),
    (0, "snake", "SECRET_NAME={}"),
    (0, "snake", "import {}"),
    (0, "snake", "secret = load({})"),
    (0, "slug", "see https://blog.host/2019/{}"),
    (0, "slug", "href=\"/posts/{}\""),
    (0, "path", "open {} first"),
    (0, "path", 'key_file = "{}"'),
    (0, "path", "ssl_certificate_key {};"),
    (0, "path", "password_file: {}"),
    (0, "path", "PATH={}:$PATH"),
    (0, "placeholder", 'token = "{}"'),
    (0, "placeholder", "password: {}"),
    (0, "placeholder", "API_KEY={}"),
    (0, "placeholder", "secret = '{}'"),
    (0, "placeholder", "Authorization: Bearer {}"),
    (0, "placeholder", "postgres://user:{}@localhost/db"),
    (0, "placeholder", "https://api.host/v1?access_token={}"),
    (0, "word", "password = \"{}\""),
    (0, "word", "token: {}"),
    (0, "word", "the secret: {}"),
    (0, "word", "key={}"),
    (0, "version", "version = \"{}\""),
    (0, "version", "built as {}"),
    (0, "public", "{}"),
    (0, "certificate", "{}"),
    (0, "b64", "ssh-rsa {} me@host"),
    (0, "gene", "the sequence {} was aligned"),
]
# Words that stand around the lines, names of files, and words that make up names.
FILLER = "and the job runs at night here we set it for all users when this part is done see note below then".split()
PATHS = [None, "", "src3", "web", "app/settings.py", "deploy/values.yaml", ".env", "README.md", "docs/setup.txt", "src/client.js", "tests/test_login.py", "main.go"]
NAMES = "user account session request handler default value current manager loader image buffer service order list item factory helper reader".split()
PLACEHOLDERS = ["changeme123", "your-token-here", "your_api_key_1", "EXAMPLE_KEY_123456", "xxxxxxxxxxxxxxxx", "XXXXXXXXXXXX1234", "0000000000000000", "1234567890abcdef", "placeholder1", "dummy-secret-1", "sample_token_01", "insert-key-here", "example-password1", "my-secret-example", "todo-change-me-1"]


def draw(kind: str, rng: random.Random) -> str:
    """A value of a kind."""

    def some(signs: str, n: int) -> str:
        return "".join(rng.choices(signs, k=n))

    low, both = string.ascii_lowercase, string.ascii_letters
    parts = rng.sample(NAMES, rng.randrange(2, 4))
    if kind.lower() in ("hex32", "hex40", "hex64"):
        found = some("0123456789abcdef", int(kind[3:]))
        return found.upper() if kind[0] == "H" else found
    if kind in ("private", "public", "certificate"):
        name = {"private": rng.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"]), "public": "PUBLIC KEY", "certificate": "CERTIFICATE"}[kind]
        lines = [some(both + string.digits + "+/", 64) for _ in range(rng.randrange(3, 20))]
        return "\n".join([f"-----BEGIN {name}-----", *lines, f"-----END {name}-----"])
    made = {
        "b64": lambda: base64.b64encode(rng.randbytes(rng.choice([24, 30, 32, 48, 64]))).decode(),
        "secret40": lambda: some(both + string.digits + "+/", 40),
        "mixed32": lambda: some(both + string.digits, rng.choice([20, 24, 32, 40])),
        "aws": lambda: "AKIA" + some(string.ascii_uppercase + "234567", 16),
        "ghp": lambda: "ghp_" + some(both + string.digits, 36),
        "slack": lambda: f"xoxb-{some(string.digits, 11)}-{some(both + string.digits, 24)}",
        "stripe": lambda: "sk_live_" + some(both + string.digits, 24),
        "jwt": lambda: "eyJ" + some(both + string.digits + "_-", rng.randrange(40, 90)),
        "short": lambda: some(low, rng.randrange(3, 8)) + some(string.digits, rng.randrange(1, 3)) + some(low + string.digits, rng.randrange(4, 7)),
        "punct": lambda: some(low, rng.randrange(3, 7)) + some("0123456789", 1) + rng.choice("!#$%*?^~") + some(both + string.digits, rng.randrange(4, 8)),
        "uuid": lambda: "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        "digits": lambda: some(string.digits, rng.randrange(16, 20)),
        "camel": lambda: parts[0] + "".join(p.title() for p in [*parts[1:], *rng.sample(NAMES, 2)]),
        "snake": lambda: "_".join([*parts, *rng.sample(NAMES, 1)]) + rng.choice(["", "", "_v2", "_1"]),
        "slug": lambda: "-".join([*parts, *rng.sample(NAMES, 2)]) + rng.choice(["", "-10", "-2"]),
        "path": lambda: "/" + "/".join([rng.choice(["etc", "var", "home", "opt"]), *parts, "file1"]),
        "placeholder": lambda: rng.choice(PLACEHOLDERS),
        "word": lambda: rng.choice(NAMES) + rng.choice(NAMES),
        "version": lambda: f"{rng.randrange(9)}-{rng.randrange(30)}-0-build-{rng.randrange(2000, 2030)}{some(string.digits, 6)}",
        "gene": lambda: some("ACGT", rng.randrange(20, 50)),
    }
    return made[kind]()


def reviewed_texts(per_kind: int = 6, seed: int = 17):
    """(line number, text, start, end, path, label) of every reviewed finding: about 200 lines and
    kinds, `per_kind` values each."""
    rng = random.Random(seed)
    for number, (label, kinds, line) in enumerate(REVIEWED):
        for kind in kinds.split():
            for _ in range(per_kind):
                value = draw(kind, rng)
                head = " ".join(rng.choices(FILLER, k=rng.randrange(0, 9)))
                tail = " ".join(rng.choices(FILLER, k=rng.randrange(0, 6)))
                before, after = line.split("{}")
                gap = rng.choice([" ", "\n", ". "]) if head else ""
                start = len(head) + len(gap) + len(before)
                yield number, f"{head}{gap}{before}{value}{after}{rng.choice([' ', chr(10)])}{tail}", start, start + len(value), rng.choice(PATHS), label
