import base64
import quopri

from strandloom.llm.mail import header_words, read_mail, shown


def test_plain_and_line_ends():
    assert read_mail("Subject: a\r\n b\r\n\r\nbody\r\n") == ("a b", ["body\n"])
    assert read_mail(None) == read_mail("") == ("", [])
    assert read_mail("\nonly body")[1] == ["only body"]


def test_encoded_words():
    assert header_words("=?utf-8?q?M=C3=BC?= =?utf-8?B?" + base64.b64encode("ller".encode()).decode() + "?= x") == "Müller x"
    assert header_words("=?utf-8?B?w?= =?utf-8?q?a_b?=") == header_words("=?utf-8?B?w?==?utf-8?q?a_b?=")
    assert header_words("=?no-such?q?a?=") == "a"


def test_parts():
    b64 = base64.encodebytes("zweiter Teil ä".encode()).decode()
    qp = quopri.encodestring("drei = drei é".encode()).decode()
    mail = (
        'Content-Type: multipart/mixed;\n boundary="b"\n\npreamble\n--b\n\nfirst\n'
        "--b\nContent-Type: multipart/alternative; boundary=b_2\n\n"
        f"--b_2\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n{b64}\n"
        f"--b_2\ncontent-type: TEXT/HTML\ncontent-transfer-encoding: Quoted-Printable\n\n<p>{qp}</p>\n--b_2--\n"
        "--b\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n\nAAAA\n"
        "--b\nContent-Disposition: attachment\n\nattached text"
    )
    subject, parts = read_mail(mail)
    assert [" ".join(p.split()) for p in parts] == ["first", "zweiter Teil ä", "drei = drei é", "attached text"]


def test_html():
    text = shown("<html><style>p{x}</style><!-- no --><body>a<b>b</b>c<br>d &lt;e&gt; &#233;&nbsp;<script>no</script></body></html>")
    assert text.split() == ["abc", "d", "<e>", "é"]
    assert "a < b" in shown("a < b")
