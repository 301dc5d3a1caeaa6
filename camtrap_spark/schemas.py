"""Fixed schemas of the inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


S, D, I, B = StringType(), DoubleType(), IntegerType(), BooleanType()

#: As the detector writes it: classifications are pairs of mixed type, read as strings.
RAW_DETECTION = _struct(category=S, conf=D, bbox=ArrayType(D), classifications=ArrayType(ArrayType(S)))
RAW_IMAGE = _struct(file=S, detections=ArrayType(RAW_DETECTION))
DETECTION_DOCUMENT = _struct(info=S, detection_categories=MapType(S, S), images=ArrayType(RAW_IMAGE))

CLASSIFICATION = _struct(species_id=S, conf=D)
DETECTION = _struct(category=S, conf=D, bbox=ArrayType(D), classifications=ArrayType(CLASSIFICATION))
#: One row per image: what all jobs take.
IMAGES = _struct(file=S, image_ord=LongType(), detections=ArrayType(DETECTION))

SEQUENCE = _struct(file_name=S, seq_id=S, frame_num=I, seq_num_frames=I, location=S)
SEQUENCE_DOCUMENT = _struct(images=ArrayType(SEQUENCE))

LABEL_STATISTICS = _struct(avg_score=D, min_score=D, max_score=D, avg_processing_time=D)
LABEL_INFO = _struct(
    timestamp=S, model_used=S, processing_method=S, batch_job_name=S, server_url=S, total_images=I, successful_labels=I, failed_labels=I, success_rate=D, statistics=LABEL_STATISTICS, is_checkpoint=B
)
LABEL_RESULT = _struct(image_path=S, image_filename=S, aesthetic_score=D, reasoning=S, processing_time=D, success=B, error=S, error_message=S)
LABEL_FILE = _struct(labeling_info=LABEL_INFO, checkpoint_info=LABEL_INFO, results=ArrayType(LABEL_RESULT))

BATCH_MANIFEST = _struct(
    batch_info=_struct(job_name=S, job_id=S, display_name=S, status=S, model=S, submission_time=S, total_images=I),
    image_list=ArrayType(_struct(index=I, path=S, filename=S)),
)
