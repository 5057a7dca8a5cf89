from pixelloom.functions.classify import is_image_file, is_video_file, media_kind  # noqa: F401
