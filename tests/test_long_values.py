"""Times that are sentences: the value comes out as unparsed, at a bounded cost."""

import time

from docloom.operators import timestamps as T

SENTENCE = "The report of the second quarter was saved by the office at noon on 3 May 2021 and sent to all members of the board"


def test_sentences_are_unparsed():
    values = [SENTENCE, SENTENCE * 2000, "one two three four five six seven eight nine ten eleven twelve 2021-05-03", "2024-10-05T18:29:40Z", "가 " * 200_000 + "a b c"]
    seconds, status = T.resolve(values, [None] * 5, ["UTC"] * 5)
    assert status == ["unparsed"] * 3 + ["resolved", "unparsed"] and seconds[3] == 1728152980


def test_cost_is_linear_in_the_length_of_a_value():
    began = time.process_time()
    for value in ("word " * 10_000, "2024.1.1" + " " * 100_000 + "z", "2024-01-01 " + "\t" * 100_000 + "10:00 x y", "1 " * 50_000, "Jan 1, 2024 " + " " * 100_000 + "10:00 AM" + " " * 100_000 + "?"):
        assert T.resolve([value], [None], ["UTC"])[1] == ["unparsed"]
    assert time.process_time() - began < 2


def test_words_of_a_shape_are_told_apart():
    tried = ("Sun Jun 19 13:48:48 KST 2022", "Sun, 19 Jun 2022 13:48:48 KST", "Feb 16, 2020 8:01:39 AM KST", "2/20/2018 1:14:52 AM KST", "2022-06-19T10:00:00 KST", "D:20180320045700Z00'00'")
    assert T.resolve(list(tried), ["en_US"] * 6, [None] * 6)[1] == ["resolved"] * 6
    # the same shapes with words that are none: no month, no zone, no half of a day, no sign of a time or date
    other = ("Sun Jux 19 13:48:48 KST 2022", "Sun, 19 Jun 2022 13:48:48 KSX", "Feb 16, 2020 8:01:39 XM KST", "2/20/2018 1:14:52 CE", "2022-06-19X10:00:00 KST", "E:20180320045700Z00'00'")
    assert T.resolve(list(other), ["en_US"] * 6, [None] * 6)[1] == ["invalid", "unparsed", "unparsed", "unparsed", "unparsed", "unparsed"]
