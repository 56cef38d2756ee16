"""Explicit schemas: manifests are never inferred, as empty arrays, absent keys and whole numbers mislead."""

UNIT = "recording string, speaker string, start double, end double, duration double, raw string, text string, flags array<string>, normalization_changes map<string,int>"
CHUNK = "example_id string, recording string, source_recording string, split string, audio string, source_audio string, text string, quality_tier string, boundary_method string, corpus string, start double, end double, duration double, overlap_seconds double, overlap_ratio double, token_count int, speaker_count int, speakers array<string>, flags array<string>, reported_other_l1_codes array<string>, explicit_other_l1 boolean, has_overlap boolean"
PREDICTION = "system string, mode string, corpus string, example_id string, blind_id string, reference string, hypothesis string, loop_repairs array<struct<attempt:int,action:string,loop_start:int,ngram_size:int,ngram_token_ids:array<int>,trigger_repetitions:int,kept_tokens:int>>"
BENCH = "blind_id string, video_id string, country string, state string, council_name string, stratum string, audio_quality string, boundary_status string, overlap string, reference string, analysis_eligible boolean, duration_seconds double"
