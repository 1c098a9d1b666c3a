"""Precision and recall of novel strings on labelled lines of code and prose."""

import random
import string

from statelake.llm.secret_scan import Novelty, every_span

HARMLESS = """
private key id: projects/my-project/locations/global/keyRings/ring1
access-key-rotation-procedure-2023-q4-final
token 1234567890123456
password reset link: https://www.example.com/account/reset-password/confirm
secret_key = os.environ.get('MY_APPLICATION_SECRET_KEY_PRODUCTION')
api key documentation lives in docs/reference/authentication/api-keys.md
token_refresh_interval_in_milliseconds_default
credentials: ${SERVICE_ACCOUNT_CREDENTIALS_FILE}
bearer AuthenticationTokenProviderFactoryBean
signature: calculateSignatureForRequestParameters
password_hash_algorithm_configuration_options
api-key 0000000000000000
secret santa organisation-committee-meeting
passphrase must contain at_least_eight_characters
access key /home/user/projects/backend/settings/local
authorization https://accounts.example.com/oauth2/authorize
private key stored in /etc/ssl/private/server-certificate
tokenizer internationalization-and-localization
the secret ingredient is ethylenediaminetetraacetic acid
password for DatabaseConnectionPoolManager2
token sequence length-normalised-log-likelihood
the secret of a good marriage is understanding-and-forgiveness
""".strip().splitlines()
ALPHABETS = {
    "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_",
    "base32": string.ascii_uppercase + "234567", "hex": "0123456789ABCDEF", "lower": string.ascii_lowercase + string.digits,
}
PLACES = [
    "curl -H 'Authorization: Bearer {}' https://api.example.com/v1/items", "the signature was {} at noon",
    "credentials = [\"{}\"]\n", "private key id {}", "export ACCESS_KEY\n{}\n",
]


def found(text, novelty):
    return [text[a:b] for a, kind, b in every_span(text, novelty) if kind != "assign"]


def test_harmless_lines():
    novelty = Novelty()
    assert [line for line in HARMLESS if found(line, novelty)] == []


def test_random_values():
    novelty, rng, hit, n = Novelty(), random.Random(4), 0, 0
    for place in PLACES:
        for letters in ALPHABETS.values():
            for size in (16, 20, 32, 64, 256):
                value = "".join(rng.choice(letters) for _ in range(size))
                n += 1
                hit += any(value.strip("=_~-+/") in f or f in value for f in found(place.format(value), novelty))
    assert n == 125 and hit >= 0.96 * n


def test_value_of_a_megabyte():
    rng = random.Random(6)
    value = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(300_000))
    assert found(f"Authorization: Bearer {value} end", Novelty()) == [value]
    assert found("Authorization: Bearer " + "abc/" * 75_000, Novelty()) == []


def test_digits_in_sensitive_places():
    rng = random.Random(7)
    novelty = Novelty()
    for size in (16, 20, 24, 32, 100):
        value = "".join(rng.choice(string.digits) for _ in range(size))
        assert found(f"bearer {value}", novelty) == [value], size  # from 24 on as a hex span
