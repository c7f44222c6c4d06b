"""Payloads that look like an ID3v1 tag."""

from cairnstore.llm import mpeg_audio


def test_letters_of_a_tag_in_the_last_frame_are_payload():
    for frames in (1, 2, 5):
        payload = b"x" * (192 * frames)
        media = mpeg_audio.store(payload)
        tagged = [mpeg_audio.store(payload[:at] + b"TAG" + payload[at + 3 :]) for at in range(192 * (frames - 1), len(payload) - 2)]
        assert any(m[-128:-125] == b"TAG" for m in tagged)
        assert {len(mpeg_audio.parse(m).offsets) for m in tagged} == {len(mpeg_audio.parse(media).offsets)} == {frames}
        assert len(mpeg_audio.parse(media + b"TAG" + bytes(125)).offsets) == frames
