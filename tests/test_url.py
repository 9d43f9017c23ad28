"""URL kernel: links put together from schemes, hosts and tails, in plain and in disguised spellings."""

import itertools
import time

import pytest
import regex
from helpers import check_censor

from textweir.kernels import text as T
from textweir.kernels import url as K

HOSTS = ["tallowquarry.net", "shop.velten.co.uk", "a-b.brindle.io", "x1.dev", "кварц.рф", "bücher.biz"]
TAILS = ["", "/", "/a/b-c", "/list?page=2&sort=up", "#part", "?q=1", ":8080", ":8080/in", "/wiki/Stone_(geology)"]
STOPS = [".", ",", "!", "?", ";", ")", "\"", ":"]


@pytest.mark.parametrize("scheme", ["http://", "https://", "HTTPS://", "hxxp://", "hxxps://"])
def test_explicit_links(scheme):
    for host, tail in itertools.product(HOSTS, TAILS):
        check_censor(K, f"read {scheme}{host}{tail} today", [f"{scheme}{host}{tail}"])


def test_explicit_hosts_of_any_kind():
    for host in ("localhost", "localhost:3000", "10.1.2.3", "10.1.2.3:81/x", "box.internal", "[2001:db8::7]", "[2001:db8::7]:8080/in"):
        check_censor(K, f"run http://{host} now", [f"http://{host}"])
    for text in ("see http:// soon", "https://", "http:/tallowquarry"):
        check_censor(K, text, [])


@pytest.mark.parametrize("tld", K.DEFAULT_TLDS)
def test_bare_domains(tld):
    for text in (f"tallowquarry.{tld}", f"WWW.TallowQuarry.{tld.upper()}", f"deep.er.tallowquarry.{tld}/path"):
        check_censor(K, f"at {text} now", [text])
    check_censor(K, f"tallowquarry.{tld}ish", [])


@pytest.mark.parametrize("text", ["one.two.three", "done.Then more", "version 2.10.3", "file.txt", "a.b", "the dot of the i", "dotted line", "tallowquarry.invalidtld/path", "e.g. this", "well...ok", "3.14", "x . y", "11:30", "and/or"])
def test_prose(text):
    check_censor(K, text, [])


@pytest.mark.parametrize("stop", STOPS)
def test_marks_after_a_link_stay(stop):
    for link in ("https://tallowquarry.net", "tallowquarry.net", "tallowquarry.net/path", "https://tallowquarry.net/a?b=1"):
        check_censor(K, f"see {link}{stop} then", [link])
        check_censor(K, f"see {link}{stop}", [link])


def test_disguised_dots():
    for dot in ("[.]", "(.)", "{.}", " [.] ", " dot ", " DOT ", "[dot]", "(dot)", " d0t ", " точка ", "。", "．"):
        check_censor(K, f"on tallowquarry{dot}net now", [f"tallowquarry{dot}net"])


def test_disguised_schemes_and_letters():
    for whole in ("h t t p : / / q u a r r y . c o m", "hxxps[:]//tallowquarry[.]net", "http[://]tallowquarry.net", "https : // tallowquarry . net", "ｈｔｔｐｓ：／／tallowquarry.net", "tallоwquarry.cоm", "tallow​quarry.net", "talloẃquarry.net"):
        check_censor(K, f"go {whole}", [whole])


def test_tails_of_bare_domains():
    for tail in ("'s", "-like", ":support"):
        check_censor(K, f"tallowquarry.net{tail}", ["tallowquarry.net"])
    check_censor(K, "tallowquarry.net:443, next", ["tallowquarry.net:443"])
    check_censor(K, "tallowquarry.net, shop.velten.co.uk and x1.dev", ["tallowquarry.net", "shop.velten.co.uk", "x1.dev"])


def test_options():
    own = K.UrlConfig(tlds=("internal",))
    assert T.censor("box.internal and a.com", K.scan("box.internal and a.com", own), "#") == "############ and a.com"
    allow = K.UrlConfig(allowed_domains=("TallowQuarry.net", "10.0.0.1", "a.com/path", "single"))
    assert allow._allowed == {"tallowquarry.net"}
    check_censor(K, "https://tallowquarry.net/x and deep.tallowquarry.net", ["deep.tallowquarry.net"], allow)
    assert K.normalize_tlds([" COM ", "com", "", None]) == ["com"]


def test_gate_is_a_superset():
    for scheme, host, tail in itertools.product(("", "http://", "hxxps[:]//"), HOSTS, TAILS):
        assert regex.search(K.gate(K.UrlConfig()), scheme + host + tail)


@pytest.mark.parametrize("part", [".", "a", "a.", "h t t p ", "http://", "[.]", "x . ", "a.com ", "dot ", "(", "://", "a@b.", "１."])
def test_linear(part):
    began = time.process_time()
    K.scan(part * (60_000 // len(part)))
    assert time.process_time() - began < 20
